"""Helpers shared by the text operators: tables, stored results, batches by bytes."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import fresh_path


def by_value(name: str) -> None:
    """Pickle the functions of a module with their code: executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins a plain scan
    on this side, so that adaptive execution may split a skewed key.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


_scopes: list[list[str]] = []  # folders of stored results, by open ``releasing`` block


@contextmanager
def releasing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at the end of the block, the results stored in it. The block is given a function
    ``keep``: what it is called with stays, until an enclosing block ends. Whatever reads the others has to
    be stored by then."""
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.stored_at)
        return df

    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.remove(made)
        if _scopes:
            _scopes[-1].extend(p for p in made if p in kept)
        for path in made:
            if path not in kept:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def quoted(name: str):
    """The column of that very name, whatever characters it has."""
    from pyspark.sql import functions as F

    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, without: str | None = None, **own) -> DataFrame:
    """All columns of ``docs`` (but for ``without``) in one struct ``row``, next to columns of the operator's own:
    no name of the user's can clash with these. ``unpacked`` takes them out again."""
    from pyspark.sql import functions as F

    row = [quoted(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != without]
    return docs.select(F.struct(*row, F.lit(1).alias("end")).alias("row"), *[c.alias(name) for name, c in own.items()])


def unpacked(df: DataFrame, names: list[str], **replaced) -> list:
    """The columns of the packed frame under their names, some of them ``replaced``."""
    from pyspark.sql import functions as F

    return [replaced.get(c, F.col(f"row.c{k}")).alias(c) for k, c in enumerate(names)]


def row_key(id_col: str):
    from pyspark.sql import functions as F

    return F.coalesce(quoted(id_col).cast("string"), F.lit(""))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most`` bytes each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


FILTER_BITS = 26


def bit_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS):
    """Broadcast bit array of 2**bits bits (8 MiB for 26, whatever the input) that holds all values
    of a bigint column by their low bits. Values outside may pass: an exact join has to follow."""
    import numpy as np
    from pyspark.sql import functions as F

    slot = f"({column} & {(1 << bits) - 1}L)"
    words = keys.selectExpr(f"int(shiftright({slot}, 6)) as word", f"shiftleft(1L, int({slot} & 63)) as bit")
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(1 << (bits - 6), np.int64)
    held[table["word"].to_numpy()] = table["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(held.view(np.uint64))


def passes(held, key):
    """Whether each uint64 value may be among those of the bit filter."""
    import numpy as np

    slot = key & np.uint64(64 * len(held) - 1)
    return (held[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def flat(column: pa.Array):
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    import numpy as np
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
