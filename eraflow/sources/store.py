"""Tables kept for a session: derived inputs, and feature passes in buckets, so that joins on their keys need no shuffle.

A table is written once for each input (the files of its folder) into the shared folder
and found again by later queries of the session. Nothing but its name is held on the
driver; a lost executor costs nothing, as the files are shared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .sinks import fresh_path

_known: dict[tuple, str] = {}


def _version(spark: SparkSession, folder: str) -> tuple:
    """What tells one state of the input from another: its files with sizes and times."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))


def bucketed(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], keys: Sequence[str], order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """The table ``name`` made from ``folder``, in buckets by ``keys``, each sorted by ``order``."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = (spark.sparkContext.applicationId, _version(spark, folder), name, tuple(keys), buckets)
    if at not in _known:
        table = f"eraflow_{name}_{uuid.uuid4().hex}"
        made = make().repartition(buckets, *keys)  # one file a bucket
        made.write.bucketBy(buckets, *keys).sortBy(*order).option("path", fresh_path(spark, name)).saveAsTable(table)
        _known[at] = table
    return spark.table(_known[at])


def kept(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], split_by: str | None = None) -> DataFrame:
    """The table ``name`` made from ``folder``; with ``split_by`` a folder per value, so that a filter on it reads its rows only."""
    at = (spark.sparkContext.applicationId, _version(spark, folder), name, split_by)
    if at not in _known:
        made, table = make(), f"eraflow_{name}_{uuid.uuid4().hex}"
        writer = made.write.option("path", fresh_path(spark, name))
        (writer.partitionBy(split_by) if split_by else writer).saveAsTable(table)
        _known[at] = table
    return spark.table(_known[at])


def joined(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Tables in the same buckets side by side."""
    return reduce(lambda a, b: a.join(b.hint("merge"), list(keys)), tables)


def forget(spark: SparkSession) -> None:
    """Drop the session's tables with their files."""
    for at in [k for k in _known if k[0] == spark.sparkContext.applicationId]:
        name = _known.pop(at)
        place = [r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r.col_name == "Location"]
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for p in place:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
