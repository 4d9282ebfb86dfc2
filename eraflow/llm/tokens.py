"""Token counts of whole texts under a given tokenizer; only lengths leave Python.

Arrow batches are cut by bytes, not rows. A long text is split at safe boundaries:
before a blank that follows something else than a blank. The tokenizer of the query
never joins across such a place (``boundary_is_safe`` looks through its vocabulary
for a piece that does), and a piece there starts with the blank mark, which the
tokenizer also puts before a text that begins without one. So the sum over the parts
is the count of the whole text, and a part that occurs often is encoded once per
batch and looked up after that.

Null texts count as empty and have no tokens. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, pieces

by_value(__name__)

_MARK = "▁"


def boundary_is_safe(model) -> bool:
    """No piece of the vocabulary has a blank mark after another character."""
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return not any(_MARK in name.lstrip(_MARK) for name in names)


def safe_parts(text: str) -> list[str]:
    """Parts of a text whose token counts add up to that of the text."""
    parts = text.replace(_MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, blanks = [], 0
    last = len(parts) - 1
    for i, part in enumerate(parts):
        if part or blanks and i == last:
            out.append(" " * blanks + part)
            blanks = 0
        elif i == last:  # one blank at the end stays with the part before it
            out[-1:] = [out[-1] + " "] if out else []
        else:
            blanks += 1
    return out if text else []


def _counts(path: str, most: int, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        safe = boundary_is_safe(model)
        known: dict[str, int] = {}
        for batch in pieces(batches, "text", most):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if safe:
                split = [safe_parts(t) for t in texts]
                fresh = list({p for parts in split for p in parts} - known.keys())
                if len(known) + len(fresh) > remembered:  # a bound on memory; forgotten parts are encoded again
                    known = {}
                    fresh = list({p for parts in split for p in parts})
                known |= zip(fresh, map(len, model.encode(fresh, num_threads=1)))
                tokens = [sum(map(known.__getitem__, parts)) for parts in split]
            else:
                tokens = [len(ids) for ids in model.encode(texts, num_threads=1)]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
                 batch_bytes: int = 1 << 20, remembered: int = 200_000) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) per row.

    ``model_path`` must be readable by every executor, as an installed package is.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    counted = texts.mapInArrow(_counts(model_path, batch_bytes, remembered), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
