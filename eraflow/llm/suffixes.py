"""Repeated byte strings across texts by merging shard suffix orders.

A text loses every byte covered by a string of ``length`` bytes that also starts
somewhere else, in another text or in the same one.

**Candidates.** Among the ``GRAM``-byte grams of a window of ``length`` bytes the one
with the least hash (the last of equal ones) is its anchor. Equal windows have equal
anchors at equal places, so a repeated window has an anchor that occurs twice. The
windows of one text with the same anchor are consecutive; together they span a snippet.
Snippets that occur twice as a whole are repeated without further work. Only anchors
with several different snippets need their bytes. Bit filters of fixed size, built by
aggregation, keep the rest of the corpus out of the shuffles; a full filter would only
let more rows through to the exact joins.

**Merging.** The different snippets of an anchor meet in one task, in shards of bounded
bytes. Each shard gets its suffix order. Shards are merged by prefix doubling over these
orders, in place of an interleave refined from Burrows-Wheeler transforms, which goes one
byte deeper per round; no transform is read and no common prefixes are kept: at depth h every suffix has the number of its block of
equal h-byte prefixes; the next depth merges the shards' own orders by (block of the
suffix, block of the suffix h further), so suffixes of a shard are never sorted again,
and depth doubles per round. Blocks at
depth ``length`` that hold two suffixes or more are the repeated intervals.

**Hot anchors.** An anchor with more than ``GROUP`` different snippets is dealt over
several such merges by a hash of the snippet. Its windows that no merge has seen twice
are then counted by their hash, with one row for each repeated interval.

Null texts count as empty. Rows may repeat and ids may be null or shared: a row is known
by its id together with a hash of its text, and equal rows have equal results. Other
columns are ignored. Memory of a task is a few megabytes of text, however long a
document is; the cut of the final text is made a document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_filter, by_value, flat, packed, passes, quoted, row_key, stored, unpacked
from .wordsums import mix, powers

by_value(__name__)

GRAM = 40
GROUP = 1200
_SPAN = 1 << 18  # bytes looked at together; positions must fit into 20 bits
_SHARD = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1


# --- candidates


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class Anchors:
    """Snippets of texts that lie one after another in ``data``; starts are window starts."""

    def __init__(self, length: int):
        self.length = length
        self.value = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
        self.powers = powers(_SPAN + 2 * length, _BASE)
        self.inverse = powers(_SPAN + 2 * length, pow(_BASE, -1, 1 << 64))

    def of(self, data: np.ndarray, offsets: np.ndarray):
        """text number, first window start, bytes, place of the anchor, anchor key, snippet key; starts are positions in ``data``."""
        n, length, width = len(data), self.length, self.length - GRAM + 1
        if n < length:
            return None
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.powers[:n], out=sums[1:])
        gram = mix((sums[GRAM:] - sums[:-GRAM]) * self.inverse[: n - GRAM + 1])
        low = np.uint64((1 << 20) - 1)
        place = np.arange(len(gram), dtype=np.uint64)
        best = _least((gram & ~low) | (low - place), width)
        anchor = (low - (best & low)).astype(np.int64)
        text = np.searchsorted(offsets, np.arange(len(anchor)), side="right") - 1
        inside = np.arange(len(anchor)) + length <= offsets[text + 1]
        new = inside.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        last = inside.copy()
        last[:-1] &= new[1:] | ~inside[1:]
        first, end = np.flatnonzero(new), np.flatnonzero(last) + length
        key = gram[anchor[first]]
        size = end - first
        snippet = mix((sums[end] - sums[first]) * self.inverse[first] + size.astype(np.uint64))
        return text[first], first, size, anchor[first] - first, key, snippet


def spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of whole texts, or overlapping ones of a long text, each window start in one:
    the batch, row numbers, bytes, offsets and the place of each stretch in its text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = flat(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + _SPAN, side="right")) - 1
            if end > at:
                yield batch, np.arange(at, end), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], np.zeros(end - at, np.int64)
                at = end
                continue
            for begin in range(int(offsets[at]), max(int(offsets[at]) + 1, int(offsets[at + 1]) - length + 1), _SPAN):
                part = data[begin : min(int(offsets[at + 1]), begin + _SPAN + length - 1)]
                yield batch, np.array([at]), part, np.array([0, len(part)]), np.array([begin - offsets[at]])
            at += 1


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _keys(length: int):
    def run(batches):
        finder = Anchors(length)
        for _, _, data, offsets, _ in spans(batches, length):
            found = finder.of(data, offsets)
            if found:
                yield pa.RecordBatch.from_arrays([_signed(found[4])], names=["anchor"])

    return run


def _snippets(length: int, bits, with_bytes: bool):
    def run(batches):
        finder = Anchors(length)
        for batch, rows, data, offsets, begin in spans(batches, length):
            found = finder.of(data, offsets)
            if not found:
                continue
            found = [a[passes(bits.value, found[4])] for a in found]
            text, first, size, place, key, snippet = found
            if with_bytes:
                lone = np.unique(np.stack([key, snippet, place.astype(np.uint64)], 1), axis=0, return_index=True)[1]
                text, first, size, place, key, snippet = (a[lone] for a in found)
                raw = data.tobytes()
                cut = pa.array([raw[a : a + n] for a, n in zip(first.tolist(), size.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([_signed(key), pa.array(place.astype(np.int32)), _signed(snippet), cut], names=["anchor", "place", "snippet", "bytes"])
            else:
                row = pa.array(rows[text])
                start = first - offsets[text] + begin[text]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(row), batch.column("text_key").take(row), pa.array(start), pa.array(size.astype(np.int32)),
                     pa.array(place.astype(np.int32)), _signed(key), _signed(snippet)],
                    names=["id", "text_key", "start", "size", "place", "anchor", "snippet"],
                )

    return run


# --- shards and their merge


def _wide(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = padded[: len(text)].copy()
    for k in range(1, 8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def _depths(length: int) -> list[tuple[int, int]]:
    """(jump, depth reached) from blocks of 8 bytes on."""
    out, h = [], 8
    while 2 * h <= length:
        out.append((h, 2 * h))
        h *= 2
    return out + ([(length - h, length)] if h < length else [])


def _numbered(ordered: np.ndarray) -> np.ndarray:
    """Number of the block of equal values for each place of a sorted array."""
    return np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.int64)


def _ahead(block: np.ndarray, position: np.ndarray, jump: int) -> np.ndarray:
    return np.where(position + jump < len(block), block[np.minimum(position + jump, len(block) - 1)] + 1, 0)


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of a shard by their first ``length`` bytes."""
    key = _wide(text)
    order = np.argsort(key, kind="stable")
    block = np.empty(len(text), np.int64)
    block[order] = _numbered(key[order])
    for jump, _ in _depths(length):
        key = (block << 32) | _ahead(block, np.arange(len(text)), jump)
        order = np.argsort(key, kind="stable")
        block[order] = _numbered(key[order])
    return order


def transform(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform: the byte before each suffix in suffix order."""
    return text[order - 1]


def merged(shards: list[np.ndarray], orders: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shards by interleave refinement: the positions (in the shards put one after
    another) in merged order, and the block of equal ``length``-byte prefixes of each."""
    base = np.cumsum([0, *map(len, shards)])
    each = np.concatenate([o + b for o, b in zip(orders, base)])  # shard by shard, each in its own order
    text = np.concatenate(shards)
    key = _wide(text)[each]
    inter = np.argsort(key, kind="stable")  # merges sorted runs
    number = _numbered(key[inter])
    block = np.empty(len(text), np.int64)
    block[each[inter]] = number
    for jump, _ in _depths(length):
        key = (block[each] << 32) | _ahead(block, each, jump)
        inter = np.argsort(key, kind="stable")
        number = _numbered(key[inter])
        block[each[inter]] = number
    return each[inter], number


def _repeated(text_parts: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each snippet, which of its windows occur twice among all snippets, and their blocks."""
    sizes = np.array([len(p) for p in text_parts])
    shards, orders, now = [], [], []
    filled = 0
    for p in [*text_parts, None]:
        if now and (p is None or filled + len(p) > _SHARD):
            shards.append(np.frombuffer(b"".join(now), np.uint8))
            orders.append(suffix_order(shards[-1], length))
            now, filled = [], 0
        if p is not None:
            now.append(p)
            filled += len(p)
    position, number = merged(shards, orders, length)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.searchsorted(begin, position, side="right") - 1
    full = position + length <= begin[owner + 1]  # other suffixes run over the end of their snippet
    count = np.bincount(number[full], minlength=number[-1] + 1)
    block = np.full(begin[-1], -1, np.int64)
    block[position[full]] = number[full]
    many = np.zeros(begin[-1], bool)
    many[position[full]] = count[number[full]] > 1
    windows = sizes - length + 1
    return [many[b : b + w] for b, w in zip(begin, windows)], [block[b : b + w] for b, w in zip(begin, windows)]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


_RESULT = pa.schema([
    ("anchor", pa.int64()), ("place", pa.int32()), ("snippet", pa.int64()), ("size", pa.int32()),
    ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("windows", pa.list_(pa.int64())), ("open", pa.list_(pa.int32())),
])


def _merge(length: int, most: int = 1 << 19):
    """Rows sorted by anchor; works through about ``most`` bytes of whole groups at a time."""

    def work(rows: list) -> pa.RecordBatch:
        many, blocks = _repeated([r[3] for r in rows], length)
        out: list[list] = [[] for _ in _RESULT]
        told: set[int] = set()
        for (anchor, place, snippet, raw, hot), flags, block in zip(rows, many, blocks):
            first, last = _runs(flags)
            hashes, opened = [], []
            if hot:  # windows to be counted over all merges of this anchor
                data = np.frombuffer(raw, np.uint8)
                finder = work.finder = getattr(work, "finder", None) or Anchors(length)
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(finder.value[data] * finder.powers[: len(data)], out=sums[1:])
                every = mix((sums[length:] - sums[:-length]) * finder.inverse[: len(data) - length + 1]).view(np.int64)
                single = np.flatnonzero(~flags)
                shared = [k for k in np.flatnonzero(flags) if block[k] not in told]
                told.update(block[shared].tolist())
                hashes = [*every[single].tolist(), *every[shared].tolist()]
                opened = [*single.tolist(), *[-1] * len(shared)]
            if first or hashes:
                for col, v in zip(out, (anchor, place, snippet, len(raw), first, last, hashes, opened)):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _RESULT)], schema=_RESULT)

    def run(batches):
        rows, filled = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "place", "snippet", "bytes", "hot"))):
                if filled > most and row[0] != rows[-1][0]:
                    yield work(rows)
                    rows, filled = [], 0
                rows.append(row)
                filled += len(row[3])
        if rows:
            yield work(rows)

    return run


# --- the operator


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(id, text_key, begin, end): maximal runs of repeated bytes, a row each; ``text_key`` is xxhash64 of the text."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    twice = stored(texts.select("text").mapInArrow(_keys(length), "anchor bigint").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "twice")
    place = "start bigint, size int, place int, anchor bigint, snippet bigint"
    found = stored(texts.mapInArrow(_snippets(length, bit_filter(twice, "anchor"), False), f"id {kind}, text_key bigint, {place}"), "snippets")
    same = ["anchor", "place", "snippet", "size"]
    kinds = stored(found.groupBy(*same).agg(F.count("*").alias("n")), "kinds")
    several = stored(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    whole = kinds.where("n > 1").select(*same, F.array(F.lit(0)).alias("first"), F.array(F.col("size") - length).alias("last"))

    fetched = texts.select("text").mapInArrow(_snippets(length, bit_filter(several, "anchor"), True), "anchor bigint, place int, snippet bigint, bytes binary").distinct()
    dealt = fetched.join(several, "anchor").select(
        "anchor", "place", "snippet", "bytes", (F.col("kinds") > GROUP).alias("hot"),
        F.pmod(F.xxhash64("snippet"), F.ceil(F.col("kinds") / GROUP)).alias("part"),
    )
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), several.agg(F.sum("kinds")).first()[0] // 10_000 if not several.isEmpty() else 1)
    ready = dealt.repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part")
    result = stored(
        ready.select("anchor", "place", "snippet", "bytes", "hot").mapInArrow(
            _merge(length), "anchor bigint, place int, snippet bigint, size int, first array<int>, last array<int>, windows array<bigint>, open array<int>"
        ), "merged"
    )
    windows = result.where("size(windows) > 0").select(*same, F.explode(F.arrays_zip("windows", "open")).alias("w")).select(*same, F.col("w.windows").alias("window"), F.col("w.open").alias("open"))
    windows = stored(windows, "windows")
    again = stored(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window"), "again")
    late = windows.where("open >= 0").join(again, ["anchor", "window"]).select(*same, F.array("open").alias("first"), F.array("open").alias("last"))
    known = stored(whole.union(result.where("size(first) > 0").select(*same, "first", "last")).union(late), "known")

    runs = found.join(known, same).select("id", "text_key", "start", F.explode(F.arrays_zip("first", "last")).alias("r"))
    covered = runs.select("id", "text_key", (F.col("start") + F.col("r.first")).alias("begin"), (F.col("start") + F.col("r.last") + length).alias("end")).distinct()
    one = Window.partitionBy("id", "text_key").orderBy("begin", "end")
    reach = F.max("end").over(one.rowsBetween(Window.unboundedPreceding, -1))
    islands = covered.withColumn("new", F.coalesce(F.col("begin") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(one))
    return islands.groupBy("id", "text_key", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island")


def _cut(batches):
    for batch in batches:
        kept, removed = [], []
        for text, runs in zip(batch.column("text"), batch.column("spans").to_pylist()):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            at, parts = 0, []
            for r in runs or ():
                parts.append(raw[at : r["begin"]])
                at = r["end"]
            kept.append(b"".join([*parts, raw[at:]]))
            removed.append(len(raw) - len(kept[-1]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("spans"), pa.array(kept, pa.binary()), pa.array(removed, pa.int64())], names=["id", "spans", "kept", "n_removed"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Per row: id, spans (removed runs of bytes), kept (the other bytes, joined), n_removed."""
    found = repeated_spans(docs, id_col, text_col, length)
    spans_of = found.groupBy(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k"), "text_key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")).withColumn("k", F.coalesce(F.col("id").cast("string"), F.lit("")))
    both = texts.join(spans_of, ["k", "text_key"], "left").select("id", "text", "spans")
    kind = texts.schema["id"].dataType.simpleString()
    out = both.mapInArrow(_cut, f"id {kind}, spans array<struct<begin:bigint,end:bigint>>, kept binary, n_removed bigint")
    return out.select(F.col("id").alias(id_col), "spans", "kept", "n_removed")


def _trim():
    def run(batches):
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column("text"), batch.column("spans").to_pylist()):
                if not runs:
                    texts.append(text.as_py())
                    continue
                raw, at, parts = text.as_buffer().to_pybytes(), 0, []
                for r in runs:  # only characters that lie in the span as a whole
                    begin, end = r["begin"], r["end"]
                    while begin < end and raw[begin] & 0xC0 == 0x80:
                        begin += 1
                    while end > begin and end < len(raw) and raw[end] & 0xC0 == 0x80:
                        end -= 1
                    parts.append(raw[at:begin])
                    at = end
                texts.append(b"".join([*parts, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def trimmed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``docs`` with the characters that lie within repeated spans taken out of the text, other columns as they are."""
    found = repeated_spans(docs, id_col, text_col, length)
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    spans_of = found.groupBy(key.alias("k"), "text_key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    keyed = packed(docs, text_col, k=row_key(id_col), text_key=F.xxhash64(quoted(text_col)), text=quoted(text_col))
    both = keyed.join(spans_of, ["k", "text_key"], "left").select("row", "text", "spans")
    cut = both.mapInArrow(_trim(), T.StructType([both.schema["row"], both.schema["text"]]))
    return cut.select(*unpacked(cut, docs.columns, **{text_col: F.col("text")}))
