"""Benchmark decontamination by greedy string tiling.

Texts are sequences of words (see ``wordsums``). A seed is a run of ``seed`` words,
known by its rolling Karp-Rabin hash over the word hashes. Seeds of the documents are
joined with those of the benchmark items; what the join leaves of a document and an
item is the list of their shared seed places, so no text is shuffled. Places on one
diagonal that follow each other make a longer match. Tiling then marks the longest
match, cuts what it overlaps out of the others, and goes on until no match of ``seed``
words is left. The share of an item's words under tiles is its coverage; passages may
be reordered or interrupted. A document is contaminated if it covers ``threshold`` of
an item or more.

Before the join, documents drop seeds that can't match by a bit filter of fixed size
over the benchmark's seeds. Seeds that very many documents share are split by adaptive
execution, as the benchmark side is a stored table.

Items with fewer than ``seed`` words, null or empty items and documents match nothing.
Items of one id with different texts count each. Rows of documents may repeat and ids may be null: a row is
known by its id and a hash of its text. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, by_value, flat, packed, passes, pieces, quoted, row_key, stored, unpacked
from .wordsums import shingles, words

by_value(__name__)

def _seeds(size: int, bits, keyed: bool):
    """Rows of seeds with their places; texts with fewer words have none."""

    def run(batches):
        for batch in pieces(batches, "text"):
            data, offsets = flat(batch.column("text"))
            hashed, cut = words(data, offsets)
            rows, places, seeds, counts = [], [], [], []
            for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                if b - a < size:
                    continue
                every = shingles(hashed[a:b], size)
                at = np.arange(len(every))
                if bits is not None:
                    at = np.flatnonzero(passes(bits.value, every))
                if len(at):
                    rows.append(np.full(len(at), i))
                    places.append(at)
                    seeds.append(every[at])
                    counts.append(np.full(len(at), b - a))
            if rows:
                row = pa.array(np.concatenate(rows))
                names = ["id", "text_key"] if keyed else ["id"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).take(row) for n in names), pa.array(np.concatenate(places).astype(np.int32)),
                     pa.array(np.concatenate(seeds).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int32))],
                    names=[*names, "place", "seed", "n_words"],
                )

    return run


def matches(places: list[tuple[int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Longest runs on diagonals: (words, place in the document, place in the item)."""
    out = []
    for a, b in sorted(set(places), key=lambda p: (p[0] - p[1], p[0])):
        if out and out[-1][1] - out[-1][2] == a - b and out[-1][1] + out[-1][0] - seed + 1 == a:
            out[-1] = (out[-1][0] + 1, out[-1][1], out[-1][2])
        else:
            out.append((seed, a, b))
    return out


def tiles(found: list[tuple[int, int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles: longest first, ties by place in the item, then in the document."""
    heap = [(-n, b, a) for n, a, b in found]
    heapq.heapify(heap)
    taken_doc: set[int] = set()
    taken_item: set[int] = set()
    out = []
    while heap:
        n, b, a = heapq.heappop(heap)
        n = -n
        free = [a + k not in taken_doc and b + k not in taken_item for k in range(n)]
        if all(free):
            out.append((n, a, b))
            taken_doc.update(range(a, a + n))
            taken_item.update(range(b, b + n))
            continue
        at = 0
        while at < n:
            end = at
            while end < n and free[end]:
                end += 1
            if end - at >= seed:
                heapq.heappush(heap, (at - end, b + at, a + at))
            at = end + 1
    return out


def _tiled(seed: int):
    def run(batches):
        for batch in batches:
            covered = []
            for row in batch.column("places").to_pylist():
                laid = tiles(matches([(p["place"], p["item_place"]) for p in row], seed), seed)
                covered.append(sum(t[0] for t in laid))
            out = batch.drop_columns(["places"])
            yield out.append_column("covered", pa.array(covered, pa.int64()))

    return run


def coverage(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
             seed: int = 5) -> DataFrame:
    """(id, text_key, item_id, n_words, coverage) for each document and item that share a seed."""
    bench = items.select(F.col(item_col).alias("id"), F.col(item_text).alias("text"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    item_kind, kind = bench.schema["id"].dataType.simpleString(), texts.schema["id"].dataType.simpleString()
    made = bench.where("id is not null").withColumn("text_key", F.xxhash64("text")).select("id", "text_key", "text").mapInArrow(
        _seeds(seed, None, True), f"id {item_kind}, text_key bigint, place int, seed bigint, n_words int"
    )
    known = stored(made.distinct().select(F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), F.col("place").alias("item_place"), "seed", "n_words"), "seeds")
    spots = texts.mapInArrow(_seeds(seed, bit_filter(known, "seed"), True), f"id {kind}, text_key bigint, place int, seed bigint, n_words int").drop("n_words")
    shared = spots.join(known, "seed")
    keys = ["id", "text_key", "item_id", "item_key", "n_words"]
    rows = shared.groupBy(*keys).agg(F.collect_list(F.struct("place", "item_place")).alias("places"))
    laid = rows.mapInArrow(_tiled(seed), f"id {kind}, text_key bigint, item_id {item_kind}, item_key bigint, n_words int, covered bigint")
    return laid.select("id", "text_key", "item_id", "n_words", (F.col("covered") / F.col("n_words")).alias("coverage"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 seed: int = 5, threshold: float = 0.5) -> DataFrame:
    """(id, text_key, item_ids, coverage): rows that cover ``threshold`` of an item; coverage is the largest."""
    hit = coverage(docs, items, id_col, text_col, item_col, item_text, seed).where(F.col("coverage") >= threshold)
    return hit.groupBy("id", "text_key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item, all columns as they are."""
    hit = contaminated(docs, items, id_col, text_col, **settings).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k"), "text_key")
    clean = packed(docs, k=row_key(id_col), text_key=F.xxhash64(quoted(text_col))).join(hit, ["k", "text_key"], "left_anti")
    return clean.select(*unpacked(clean, docs.columns))
