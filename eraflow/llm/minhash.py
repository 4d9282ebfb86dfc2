"""Near-duplicate texts by MinHash bands, confirmed on the full shingle sets.

1. Each text becomes the set of its word shingles. ``bands * rows`` universal hashes
   give its minima; a signature keeps 16 bits of each, and ``rows`` of them make one
   band key. Texts with equal sets collapse to their least id before anything else,
   so copies cost one row each, however many there are.
2. Texts that share a band key meet in a bucket, whose pivot is one of them. No pairs
   are made inside a bucket: in two rounds, over a quarter of the bands and the others,
   a text is compared with one pivot, that with which it shares most buckets. Pivots are
   the members with the fullest buckets, so copies meet the text they were made from. Components of the confirmed
   links follow, and later rounds only look into buckets that still hold several.
3. Last, texts that share a bucket but lie in different components are compared, each
   pair once, so no candidate pair across components is left untested but by an exact bound:
   the shingles of these texts are put in one order, about rarest first (a table of fixed size
   holds how often the shingles of a slot occur), and a text shows its first ``SHOWN`` percent. If
   those of x end before those of y, x has at most the shown shingles of both and its unshown ones in common
   with y. Shown shingles are bits of a map; those that fell on a bit already set count as common. Near copies of one text that each changed too much fail it, as their rarest shingles
   are their own; a text of which too many shingles occur nowhere else meets nobody.
4. Before full sets are compared, pairs whose set sizes rule a link out, or whose
   signatures differ in too many bits, are dropped. A bit is hashed from one minimum and its
   place, so bits of different minima are independent also in sets of few shingles. A pair of
   similarity 0.8 differs in 13 of 128 bits in the mean, and in more than 39 with a chance of 3e-11.
   Components come from alternating large-star and small-star.

With 32 bands of 4 rows a pair of similarity 0.8 shares no bucket with a chance of 5e-8.

Null or empty texts and texts without words have an empty set and link with nothing.
Rows with a null id link with nothing, have a null component and are kept. Rows that
repeat an id count as one document; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, by_value, flat, packed, passes, pieces, quoted, releasing, stored, unpacked
from .components import connected
from .wordsums import mix, shingles, words

by_value(__name__)

BANDS, ROWS = 32, 4
LOST = 1e-10  # chance at which a test on signatures may drop a link
SLOTS = 24  # the table of shingle counts has 2**SLOTS numbers of four bits, 8 MiB
SHOWN = 40  # percent of a set, rarest first, that the overlap bound looks at
MOST_SHOWN = 1024  # and shingles at most: fewer weaken the bound, no link is lost
WORDS = 32  # the shown shingles are kept as a bit map of that many words


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return seeds[:count] | np.uint64(1), seeds[count:]


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    data, offsets = flat(batch.column("text"))
    hashed, cut = words(data, offsets)
    return [np.unique(shingles(hashed[a:b], size)) for a, b in zip(cut[:-1], cut[1:])]


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _coefficients(bands * rows)
        tags = _coefficients(2)[0]
        for batch in pieces(batches, "text"):
            sets = _sets(batch, size)
            counts = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(counts)
            low = np.zeros(len(sets), np.uint64)
            high = np.zeros(len(sets), np.uint64)
            minima = np.zeros((len(sets), bands * rows), np.uint16)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                begin = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                for k in range(bands * rows):
                    minima[full, k] = np.minimum.reduceat(every * mul[k] + add[k], begin) & np.uint64(0xFFFF)
                low[full] = np.add.reduceat(mix(every * tags[0]), begin)
                high[full] = np.add.reduceat(mix(every * tags[1]), begin)
            keys = pa.array(minima.view(np.int64).ravel() if rows == 4 else _keys(minima, bands, rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(counts),
                    pa.array(low.view(np.int64)),
                    pa.array(high.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), keys),
                    pa.array([list(b) for b in _bits(minima).tolist()], pa.list_(pa.int64())),
                ],
                names=["id", "n_shingles", "low", "high", "bands", "bits"],
            )

    return run


def _bits(minima: np.ndarray) -> np.ndarray:
    """A bit hashed from every minimum and its place, 64 to a number; zeros fill the last number.

    The lowest bit itself would not do: in x * odd + add it is that of x, but for a constant.
    """
    place = np.arange(minima.shape[1], dtype=np.uint64) << np.uint64(16)
    packed = np.packbits((mix(minima + place) & np.uint64(1)).astype(np.uint8), axis=1)
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return np.ascontiguousarray(packed).view(np.int64)


def _keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    wide = minima.reshape(-1, rows).astype(np.uint64)
    key = np.zeros(len(wide), np.uint64)
    for k in range(rows):
        key = mix(key + wide[:, k] + np.uint64(k + 1))
    return key.view(np.int64)


def _full_sets(size: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (b.filter(pa.array(passes(held.value, b.column("slot").to_numpy(zero_copy_only=False).view(np.uint64)))) for b in batches if b.num_rows)
        for batch in pieces(wanted, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([s.tobytes() for s in _sets(batch, size)], pa.large_binary())], names=["id", "shingles"]
            )

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                common = both - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= percent * (both - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compatible(percent: int, most_bits: int) -> str:
    """SQL test on the sizes and signature bits of two texts, exact on sizes."""
    agree = "aggregate(zip_with(bits, other_bits, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return f"100 * least(n, other_n) >= {percent} * greatest(n, other_n) and {agree} <= {most_bits}"


def _sets_of(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Full sets of the texts in ``pairs``. The scan keeps what passes a bit filter; texts are not shuffled."""
    need = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    slotted = texts.select("id", "text", F.xxhash64("id").alias("slot"))
    held = bit_filter(need.select(F.xxhash64("id").alias("slot")), "slot")
    return stored(slotted.mapInArrow(_full_sets(size, held), "id bigint, shingles binary"), "sets")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among the stored candidate ``pairs``."""
    sets = _sets_of(pairs, texts, size)
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return stored(both.mapInArrow(_linked(percent), "a bigint, b bigint").distinct(), "links")


def _tile(percent: int):
    """Links among the pairs of one tile; rows are sets (a, shingles) or pairs (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        table = table.combine_chunks()
        given = table.filter(pc.is_valid(table["shingles"]))
        sets = {i: np.frombuffer(x.as_buffer(), np.uint64) for i, x in zip(given["a"].to_pylist(), given["shingles"])}
        asked = table.filter(pc.is_valid(table["b"])).sort_by("a")
        left, right = asked["a"].to_numpy(), asked["b"].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1], [True]])) if len(left) else np.zeros(1, int)
        linked = np.zeros(len(left), bool)
        for s, e in zip(edge[:-1], edge[1:]):
            own = sets[left[s]]
            others = [sets[b] for b in right[s:e].tolist()]
            sizes = np.array([len(o) for o in others])
            every = np.concatenate(others)
            at = np.minimum(np.searchsorted(own, every), len(own) - 1)
            common = np.add.reduceat((own[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            linked[s:e] = 100 * common >= percent * (len(own) + sizes - common)
        return pa.table({"a": pa.array(left[linked], pa.int64()), "b": pa.array(right[linked], pa.int64())})

    return run


def _verified_in_tiles(pairs: DataFrame, sets: DataFrame, percent: int, tile: int = 512) -> DataFrame:
    """Links among stored ``pairs`` that lie close together: each set goes to a tile once, not to each of its pairs.

    Groups of candidates are cut into blocks of about ``tile`` texts, and every pair of
    blocks is a tile; small groups share tiles.
    """
    group = stored(connected(pairs), "candidates")
    blocks = stored(group.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks")), "blocks")
    shared = max(1, group.count() // tile)
    key = F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("component"), F.lit(shared))).otherwise(F.col("component"))
    spot = stored(group.join(blocks, "component").select("id", key.alias("tile"), "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")), "spots")
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    whole = sets.join(spot, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    there = spot.select(F.col("id").alias("b"), F.col("block").alias("other"))
    asked = pairs.select("a", "b").join(spot.select(F.col("id").alias("a"), "tile", "block"), "a").join(there, "b")
    rows = whole.select("tile", low, high, F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), "shingles").union(
        asked.select("tile", low, high, "a", "b", F.lit(None).cast("binary"))
    )
    return stored(rows.groupBy("tile", "low", "high").applyInArrow(_tile(percent), "a bigint, b bigint").distinct(), "links")


def _component(df: DataFrame, part: DataFrame | None, column: str) -> DataFrame:
    """Adds the component of ``column`` as c<column>; a node without links is its own."""
    if part is None:
        return df.withColumn("c" + column, F.col(column))
    found = part.select(F.col("id").alias(column), F.col("component").alias("c" + column))
    return df.join(found, column, "left").withColumn("c" + column, F.coalesce("c" + column, column))


def _tail(count: int, p: float) -> list[float]:
    """Chances of more than 0, 1, ... successes in ``count`` trials."""
    each = [math.comb(count, k) * p**k * (1 - p) ** (count - k) for k in range(count + 1)]
    return [math.fsum(each[k + 1 :]) for k in range(count + 1)]


def _most_bits(count: int, similarity: float) -> int:
    """Bits in which a pair of that similarity may differ; more have a chance below ``LOST``."""
    return next(k for k, chance in enumerate(_tail(count, (1 - similarity) / 2)) if chance < LOST)


def _least_places(count: int, similarity: float) -> int:
    """Minima in which a pair of that similarity agrees at least; fewer have a chance below ``LOST``."""
    return count - next(k for k, chance in enumerate(_tail(count, 1 - similarity)) if chance < LOST)


def _mixed_buckets(placed: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """Rows (a, ca, band, key) of the bands from ``low`` to ``high``, and the buckets that hold several components, with one member b and their size m."""
    rowed = placed.select("a", "ca", F.posexplode(F.slice("bands", low + 1, high - low)).alias("at", "key")).select("a", "ca", (F.col("at") + low).alias("band"), "key")
    seen = rowed.groupBy("band", "key").agg(F.min_by("a", F.xxhash64("a")).alias("b"), F.count("*").alias("m"), F.min("ca").alias("least"), F.max("ca").alias("most"))
    return rowed, stored(seen.where("least <> most").select("band", "key", "b", "m"), "mixed")


def _best_pivots(alone: DataFrame, part: DataFrame | None, low: int, high: int, test: str) -> DataFrame:
    """For each text the pivot it shares most mixed buckets with, if that lies in another component and may be a link.

    The pivot of a bucket is the member whose buckets are the fullest: the text that the others were copied from.
    """
    placed = _component(alone, part, "a")
    rowed, mixed = _mixed_buckets(placed, low, high)
    inside = stored(rowed.join(mixed, ["band", "key"]).select("a", "band", "key", "m"), "inside")
    fullness = stored(inside.groupBy("a").agg(F.sum("m").alias("fullness")), "fullness")
    pivots = inside.join(fullness, "a").groupBy("band", "key").agg(F.max_by("a", "fullness").alias("b"))
    pairs = inside.join(stored(pivots, "pivots"), ["band", "key"]).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    best = stored(pairs.groupBy("a").agg(F.max_by("b", "shared").alias("b")), "best")
    other = placed.select(F.col("a").alias("b"), F.col("ca").alias("cb"), F.col("n").alias("other_n"), F.col("bits").alias("other_bits"))
    both = best.join(placed.select("a", "ca", "n", "bits"), "a").join(other, "b")
    return stored(both.where(f"ca <> cb and {test}").select("a", "b").distinct(), "first")


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) & np.uint64((1 << SLOTS) - 1)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "shingles"):
        slot, n = np.unique(_slots(np.frombuffer(flat(batch.column("shingles"))[0].tobytes(), np.uint64)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], names=["slot", "n"])


def _levels(sets: DataFrame):
    """Broadcast table of fixed size: for each slot of shingles the binary logarithm of their number, 15 at most, sixteen to a word."""
    counts = sets.select("shingles").mapInArrow(_slot_counts, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    level = "shiftleft(bigint(least(15, floor(log2(n)))), int(4 * (slot & 15)))"
    words = counts.where("n > 1").selectExpr("int(shiftright(slot, 4)) as word", f"{level} as bits")
    table = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(1 << (SLOTS - 4), np.int64)
    held[table["word"].to_numpy()] = table["bits"].to_numpy()
    return sets.sparkSession.sparkContext.broadcast(held.view(np.uint64))


_MARKS = ["map", "last", "shown", "spare"]
_SHOWN = "a bigint, map array<bigint>, last bigint, shown int, spare int"


def _rarest(levels, percent: int):
    """For each set a bit map of the shingles it shows, the last of them in the common order (four bits of
    the level, then the hash), their number, and how many of them fell on a bit already set. Sets that can't link are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "shingles"):
            out: list[list] = [[], [], [], [], []]
            for i, raw in zip(batch.column("id").to_pylist(), batch.column("shingles")):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                slot = _slots(own)
                level = (levels.value[slot >> 4] >> (slot & 15).astype(np.uint64) * np.uint64(4)) & np.uint64(15)
                if 100 * np.count_nonzero(level) < percent * len(own):
                    continue  # the others are nobody else's
                code = np.sort((level << np.uint64(59)) | (mix(own) >> np.uint64(5)))
                code = code[: min(MOST_SHOWN, SHOWN * len(own) // 100 + 1)]
                bits = np.zeros(64 * WORDS, np.uint8)
                bits[(mix(code) % np.uint64(64 * WORDS)).astype(np.int64)] = 1
                row = (i, np.packbits(bits).view(np.int64).tolist(), int(code[-1]), len(code), len(code) - int(bits.sum()))
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["a", "map", "last", "shown", "spare"])

    return run


def _overlap(percent: int) -> str:
    """SQL test whether two sets can have enough in common, by what they show."""
    both = " + ".join(f"bit_count(map[{k}] & other_map[{k}])" for k in range(WORDS))
    beyond = "if(last <= other_last, n - shown, other_n - other_shown)"
    return f"{100 + percent} * ({both} + least(spare, other_spare) + {beyond}) >= {percent} * (n + other_n)"


def _rest(alone: DataFrame, part: DataFrame | None, texts: DataFrame, size: int, percent: int, bands: int, test: str, least: int) -> tuple[DataFrame, DataFrame]:
    """All pairs of one bucket, in different components, that may be links, and the sets they need. A pair that shares several
    buckets is made in the first one."""
    placed = _component(alone, part, "a")
    rowed, mixed = _mixed_buckets(placed, 0, bands)
    places = stored(rowed.join(mixed.select("band", "key", "b"), ["band", "key"]), "places")
    sets = _sets_of(places.select("a", F.col("a").alias("b")).distinct(), texts, size)
    rare = stored(sets.mapInArrow(_rarest(_levels(sets), percent), _SHOWN), "rare")
    pivot = placed.select(F.col("a").alias("b"), F.col("ca").alias("cb")).distinct()
    whole = placed.select("a", "n", "bits", "bands").join(rare, "a")
    inside = stored(places.join(pivot, "b").join(whole, "a").select("band", "key", "a", "ca", "cb", "n", "bits", "bands", *_MARKS), "inside")
    out = inside.where("ca <> cb").select(
        "band", "key", F.col("a").alias("x"), F.col("ca").alias("cx"),
        F.col("n").alias("other_n"), F.col("bits").alias("other_bits"), F.col("bands").alias("other_bands"), *[F.col(c).alias("other_" + c) for c in _MARKS],
    )
    # 16-bit places in which whole signatures agree
    lanes = "int(v & 65535L = 0) + int(shiftrightunsigned(v, 16) & 65535L = 0) + int(shiftrightunsigned(v, 32) & 65535L = 0) + int(shiftrightunsigned(v, 48) = 0)"
    agree = f"aggregate(zip_with(bands, other_bands, (p, q) -> p ^ q), 0, (s, v) -> s + {lanes}) >= {least}" if least else "true"
    once = "array_position(zip_with(bands, other_bands, (p, q) -> p = q), true) = band + 1"
    meet = inside.join(out, ["band", "key"]).where(f"ca <> cx and (ca = cb or x < a) and {_overlap(percent)} and {test} and {once} and {agree}")
    return stored(meet.select(F.col("x").alias("a"), F.col("a").alias("b")).distinct(), "late"), sets


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (least id reachable), kept.

    Two texts are linked if 100 * common shingles >= ``percent`` * all shingles of both.
    """
    with releasing(docs.sparkSession) as keep:
        texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        member = keep(_members(texts, size, bands, rows))
        part = _linked_parts(member, texts, size, percent, bands, rows, keep)
    if part is None:
        return _result(member.withColumn("component", F.lit(None).cast("bigint")), id_col)

    root = part.select(F.col("id").alias("rep"), "component")
    return _result(member.join(root, "rep", "left"), id_col)


def _members(texts: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """For each row the least id ``rep`` of its equal sets; bands and bits for that id only."""
    with releasing(texts.sparkSession) as keep:
        schema = "id bigint, n_shingles bigint, low bigint, high bigint, bands array<bigint>, bits array<bigint>"
        marked = stored(texts.mapInArrow(_signatures(size, bands, rows), schema), "signatures")
        same = ["low", "high", "n_shingles"]
        equal = stored(
            marked.where("n_shingles > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "equal"
        )
        rep = F.when(F.col("n_shingles") > 0, F.coalesce("rep", "id"))
        shown = [F.when(F.col("id") == rep, F.col(c)).alias(c) for c in ("bands", "bits")]
        return keep(stored(marked.join(equal, same, "left").select("id", F.col("n_shingles").alias("n"), rep.alias("rep"), *shown), "members"))


def _linked_parts(member: DataFrame, texts: DataFrame, size: int, percent: int, bands: int, rows: int, keep_last) -> DataFrame | None:
    """(id, component) of the linked texts, None without links."""
    spark = member.sparkSession
    alone = member.where("bands is not null").select(F.col("id").alias("a"), "n", "bits", "bands")
    test = _compatible(percent, _most_bits(bands * rows, percent / 100))
    links = part = None
    for low, high in ((0, bands // 4), (bands // 4, bands)):
        with releasing(spark) as keep:
            first = _best_pivots(alone, part, low, high, test)
            if not first.isEmpty():
                fresh = _verified(first, texts, size, percent)
                links = keep(fresh if links is None else stored(links.union(fresh), "links"))
                part = keep(stored(connected(links), "part"))
    with releasing(spark) as keep:
        late, sets = _rest(alone, part, texts, size, percent, bands, test, _least_places(bands * rows, percent / 100) if rows == 4 else 0)
        if not late.isEmpty():
            fresh = _verified_in_tiles(late, sets, percent)
            part = keep(stored(connected(fresh if links is None else links.union(fresh)), "part"))
    return part if part is None else keep_last(part)


def _result(found: DataFrame, id_col: str) -> DataFrame:
    out = found.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the least id of their group of near-duplicates; rows that repeat id and text once."""
    stay = near_duplicates(docs, id_col, text_col, size, percent).where("kept").select(quoted(id_col).alias("id")).where("id is not null").distinct()
    known = packed(docs, id=quoted(id_col), text_key=F.xxhash64(quoted(text_col))).join(stay, "id", "left_semi")
    once = known.dropDuplicates(["id", "text_key"])
    return once.select(*unpacked(once, docs.columns)).union(docs.where(quoted(id_col).isNull()))
