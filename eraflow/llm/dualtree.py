"""Ranked lexical search by a dual tree over items and documents.

The score of a document for an item sums, over the item's terms, a coordinate of the
document that doesn't depend on the item: the term's weight times a saturated term
frequency, all in whole numbers. So an item is a 0/1 vector and a score is a product.

* Documents become vectors over the terms that any item has. A bit filter of fixed
  size (8 MiB) spares other terms on the way; an exact join follows.
* Each task makes tiles of ``_ROWS`` vectors, ordered so that like ones lie together,
  with a hierarchy of nodes that hold the coordinate maxima of their vectors. The
  items of a block have a hierarchy too: a node holds the maxima of its items, that is
  all their terms, and the weakest k-th score among them.
* The product of two nodes' maxima bounds all scores between them. A pair whose bound
  is below the weakest k-th score goes, with all its items and documents; equal bounds
  stay, as the smaller id wins a tie. So the result is exact.
* A first pass scores the most promising leaf of every tile, which gives each item a
  k-th score to start with; the second pass searches all tiles against these.

Items are taken in blocks of bounded size, so what goes to every task doesn't grow; a
block holds ``block_terms`` terms at most, or one larger item.

Null and empty texts have no terms: such documents don't count, such items return no
rows. Repeated documents are ranked each; equal items (id and text) count once, items
with one id and different texts are ranked apart. Null ids rank last among equal
scores. No items or no documents give no rows. Other columns are ignored. Very long
texts are read in parts; a vector has one entry per different term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_filter, by_value, pieces, stored
from .terms import Sieve, term_lists

by_value(__name__)

_ROWS, _LEAF, _WIDE, _GROUP = 2048, 8, 8, 12


def _vectors(held, most: int):
    """Per row: number of terms, and the terms that pass the filter with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        sieve = Sieve(held.value) if held is not None else None
        for batch in pieces(batches, "text", most):
            sizes, terms, counts, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                n, own = 0, {}
                for words in term_lists(text or b""):
                    n += len(words)
                    if sieve is not None:
                        words = filter(sieve.look(set(words)).__contains__, words)
                    for word in words:
                        own[word] = own.get(word, 0) + 1
                sizes.append(n)
                terms.append(own.keys())
                counts.append(own.values())
                ends.append(ends[-1] + len(own))
            flat = pa.array(list(itertools.chain.from_iterable(terms)), pa.binary()).cast(pa.string())
            many = pa.array(list(itertools.chain.from_iterable(counts)), pa.int64())
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, many)],
                names=["id", "n", "terms", "tf"],
            )

    return run


def vectors(table: DataFrame, id_col: str, text_col: str, held=None, most: int = 4 << 20) -> DataFrame:
    """id, n (terms with repeats), terms, tf per row; with a bit filter only terms that pass."""
    texts = table.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([
        T.StructField("id", texts.schema["id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tf", T.ArrayType(T.LongType())),
    ])
    return texts.mapInArrow(_vectors(held, most), schema)


class Items:
    """A block of items: terms with weights, and a hierarchy of three levels over the items."""

    def __init__(self, uids, starts, terms, known, weights):
        """``terms`` holds the places in ``known`` (sorted) of all items' terms, ``starts`` where each item begins."""
        import numpy as np

        self.known, self.weights = known, weights
        lists = [terms[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        # light terms first: items of one language or subject lie together
        order = sorted(range(len(lists)), key=lambda k: tuple(sorted(zip(weights[lists[k]].tolist(), lists[k].tolist(), strict=True))[:6]))
        self.uids = np.asarray(uids)[order]
        self.lists = [lists[k] for k in order]
        self.groups = [(a, min(a + _GROUP, len(order))) for a in range(0, len(order), _GROUP)]
        self.maxima = [np.unique(np.concatenate(self.lists[a:b])) for a, b in self.groups]
        self.all = np.unique(np.concatenate(self.lists)) if self.lists else np.zeros(0, np.int64)


class Tile:
    """Vectors of some documents over a block's terms, with the coordinate maxima of three levels of nodes."""

    def __init__(self, batch: pa.RecordBatch, items: Items, n_docs: int, n_terms: int):
        import numpy as np
        import pyarrow.compute as pc

        self.ids = batch.column("id")
        lists, many = batch.column("terms"), batch.column("tf")
        rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        place = pc.index_in(pc.list_flatten(lists), value_set=items.known)
        col = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        tf = pc.list_flatten(many).to_numpy(zero_copy_only=False).astype(np.int64)
        rows, col, tf = rows[col >= 0], col[col >= 0], tf[col >= 0]
        norm = np.array([10 + 90 * int(n) * n_docs // max(1, n_terms) for n in batch.column("n").to_pylist()], np.int64)
        value = items.weights[col] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[rows]))
        # rows with the same heaviest coordinate lie together, those without any last
        n = len(self.ids)
        top, heaviest = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        by = np.lexsort((value, rows))
        last = np.flatnonzero(np.diff(rows[by], append=-1))
        top[rows[by][last]], heaviest[rows[by][last]] = col[by][last], value[by][last]
        order = np.lexsort((heaviest, top))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.order = order
        place = np.empty(n, np.int64)
        place[pc.array_sort_indices(self.ids, null_placement="at_end").to_numpy()] = np.arange(n)
        self.tie = place[order]
        rows = rank[rows]
        by = np.lexsort((rows, col))
        self.col, self.row, self.value = col[by], rows[by], value[by]
        self.terms, first = np.unique(self.col, return_index=True)
        self.first = np.append(first, len(self.col))
        leaves = -(-n // _LEAF)
        self.leaves = -(-leaves // _WIDE**2) * _WIDE**2
        at = np.zeros(len(items.known) + 1, np.int64)
        at[self.terms] = np.arange(len(self.terms)) + 1
        self.at = at
        fine = np.zeros((len(self.terms) + 1, self.leaves), np.int64)
        cell = at[self.col] * self.leaves + self.row // _LEAF
        if len(cell):
            edge = np.flatnonzero(np.diff(cell, prepend=-1))
            fine.ravel()[cell[edge]] = np.maximum.reduceat(self.value, edge)
        middle = fine.reshape(len(fine), -1, _WIDE).max(2)
        self.levels = [middle.reshape(len(fine), -1, _WIDE).max(2), middle, fine]

    def bounds(self, level: int, terms, nodes):
        """Upper bounds of all scores between an item node, given by its terms, and document nodes of a level."""
        import numpy as np

        rows = self.at[terms]
        return self.levels[level][np.ix_(rows[rows > 0], nodes)].sum(0)

    def scores(self, terms, leaves):
        """Exact scores of the rows in the given leaves, as (row, score) with score above 0."""
        import numpy as np

        rows = self.at[terms] - 1
        rows = rows[rows >= 0]
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        picked = np.concatenate([np.arange(self.first[r], self.first[r + 1]) for r in rows])
        wanted = np.zeros(self.leaves, bool)
        wanted[leaves] = True
        picked = picked[wanted[self.row[picked] // _LEAF]]
        total = np.zeros(self.leaves * _LEAF, np.int64)
        np.add.at(total, self.row[picked], self.value[picked])
        found = np.flatnonzero(total)
        return found, total[found]


def _tiles(batches: Iterator[pa.RecordBatch], items: Items, stats: tuple[int, int], most: int) -> Iterator[Tile]:
    """Tiles of ``_ROWS`` rows, or fewer where their vectors have ``most`` entries; one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        total = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right"))
            end = max(at + 1, min(end, at + _ROWS))
            yield Tile(batch.slice(at, end - at), items, *stats)
            at = end


def _first_scores(block, stats, k: int, most: int):
    """uid, score: k best scores of each item among the most promising leaf of every tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        items = block.value
        best = [np.zeros(0, np.int64) for _ in items.lists]
        for tile in _tiles(batches, items, stats, most):
            every = np.arange(tile.leaves)
            for i, terms in enumerate(items.lists):
                leaf = int(np.argmax(tile.bounds(2, terms, every)))
                score = tile.scores(terms, [leaf])[1]
                best[i] = np.sort(np.concatenate([best[i], score]))[-k:]
        sizes = [len(b) for b in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(items.uids, sizes), pa.int64()), pa.array(np.concatenate([*best, np.zeros(0, np.int64)]), pa.int64())], names=["uid", "score"]
        )

    return run


def _search(block, floor, stats, k: int, most: int):
    """uid, id, score: the k best documents of each item among a task's, by both hierarchies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        items, least = block.value, np.maximum(floor.value, 1)
        best: list[list[tuple]] = [[] for _ in items.lists]
        kind = None
        for tile in _tiles(batches, items, stats, most):
            kind = tile.ids.type
            roots = np.arange(tile.levels[0].shape[1])
            roots = roots[tile.bounds(0, items.all, roots) >= least.min()]
            for (a, b), terms in zip(items.groups, items.maxima, strict=True) if len(roots) else ():
                weakest = least[a:b].min()
                nodes = roots[tile.bounds(0, terms, roots) >= weakest]
                nodes = (nodes[:, None] * _WIDE + np.arange(_WIDE)).ravel()
                nodes = nodes[tile.bounds(1, terms, nodes) >= weakest]
                for i in range(a, b) if len(nodes) else ():
                    own = nodes[tile.bounds(1, items.lists[i], nodes) >= least[i]]
                    own = (own[:, None] * _WIDE + np.arange(_WIDE)).ravel()
                    own = own[tile.bounds(2, items.lists[i], own) >= least[i]]
                    if not len(own):
                        continue
                    row, score = tile.scores(items.lists[i], own)
                    row, score = row[score >= least[i]], score[score >= least[i]]
                    if not len(row):
                        continue
                    top = np.lexsort((tile.tie[row], -score))[:k]
                    ids = tile.ids.take(pa.array(tile.order[row[top]])).to_pylist()
                    merged = best[i] + [(-int(s), x is None, x) for s, x in zip(score[top], ids, strict=True)]
                    best[i] = sorted(merged, key=lambda t: (t[0], t[1], 0 if t[1] else t[2]))[:k]
                    if len(best[i]) == k:
                        least[i] = max(least[i], -best[i][-1][0])
        if kind is not None:
            sizes = [len(b) for b in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(items.uids, sizes), pa.int64()), pa.array([x for b in best for _, _, x in b], kind), pa.array([-s for b in best for s, _, _ in b], pa.int64())],
                names=["uid", "id", "score"],
            )

    return run


def _block(items: DataFrame, frequency: DataFrame, n_docs: int) -> Items:
    """The items of one block (bounded) with the weights of their terms."""
    import numpy as np

    asked = items.select("uid", F.explode("terms").alias("term"))
    found = asked.join(frequency, "term").orderBy("uid", "term").toArrow()
    known = pa.array(sorted(set(found["term"].to_pylist()), key=str.encode), pa.string())
    rare = dict(zip(found["term"].to_pylist(), found["df"].to_pylist(), strict=True))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * rare[t] + 1))) for t in known.to_pylist()], np.int64)
    import pyarrow.compute as pc

    terms = pc.index_in(found["term"], value_set=known).to_numpy().astype(np.int64)
    uid = found["uid"].to_numpy()
    starts = np.flatnonzero(np.diff(uid, prepend=-1)) if len(uid) else np.zeros(0, np.int64)
    return Items(uid[starts], np.append(starts, len(uid)), terms, known, weights)


def _blocks(items: DataFrame, most: int) -> list[DataFrame]:
    """Items by hash into blocks of at most ``most`` terms; a larger item has a block with few others."""
    total, largest = items.agg(F.sum(F.size("terms")), F.max(F.size("terms"))).first()
    if not total:
        return []
    n = max(1, -(-2 * total // most)) if total > most else 1
    block = lambda: F.pmod(F.xxhash64("uid"), F.lit(n))
    while items.groupBy(block().alias("b")).agg(F.sum(F.size("terms")).alias("s")).agg(F.max("s")).first()[0] > max(most, 2 * largest):
        n *= 2
    return [items.where(block() == k) for k in range(n)]


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
           block_terms: int = 1 << 16, tile_entries: int = 1 << 20) -> DataFrame:
    """item id, rank (from 1), doc id, score: the ``k`` best documents of each item with a score above 0.

    The weight of a term is floor(1000 ln((2 N + 2) / (2 df + 1))), its frequency counts as
    10^9 tf div (1000 tf + 8 m) with m = 10 + 90 n N div L, for N documents with L terms in all,
    df with this term, n terms and tf of this one in the document.
    """
    unique = items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).distinct()
    asked = stored(vectors(unique, "i", "t").where("n > 0").select(F.monotonically_increasing_id().alias("uid"), F.col("id").alias("item"), "terms"), "items")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    held = bit_filter(terms.select(F.xxhash64("term").alias("h")), "h")
    read = stored(vectors(docs, doc_col, text_col, held).where("n > 0"), "vectors")
    n_docs, n_terms = read.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    used = stored(read.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(terms, "term", "left_semi"), "frequency")
    found = None
    kind = T.StructType([T.StructField("uid", T.LongType()), T.StructField("id", read.schema["id"].dataType), T.StructField("score", T.LongType())])
    best_of = Window.partitionBy("uid").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    for part in _blocks(asked, block_terms):
        found = _ranked_block(read, _block(part, used, n_docs), (n_docs, n_terms), kind, k, tile_entries, found)
    if found is None:
        found = docs.sparkSession.createDataFrame([], kind)
    top = found.withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") <= k)
    return top.join(asked.select("uid", "item"), "uid").select(F.col("item").alias(item_col), "rank", F.col("id").alias(doc_col), "score")


def _ranked_block(read: DataFrame, items: Items, stats: tuple[int, int], kind: T.StructType, k: int, most: int, before: DataFrame | None) -> DataFrame:
    import numpy as np

    spark = read.sparkSession
    block = spark.sparkContext.broadcast(items)
    first = read.mapInArrow(_first_scores(block, stats, k, most), "uid bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score")))
    floors = first.withColumn("p", place).where(F.col("p") == k).select("uid", "score").toArrow()
    floor = np.zeros(len(items.uids), np.int64)
    at = {int(u): i for i, u in enumerate(items.uids)}
    for u, s in zip(floors["uid"].to_pylist(), floors["score"].to_pylist(), strict=True):
        floor[at[u]] = s
    found = stored(read.mapInArrow(_search(block, spark.sparkContext.broadcast(floor), stats, k, most), kind), "ranked")
    return found if before is None else before.union(found)
