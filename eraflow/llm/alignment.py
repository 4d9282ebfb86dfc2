"""Alignment of two tokenizers over the same texts.

A reads a space and the text, B reads the text and adds the space itself. Both cut
the same bytes into tokens; where a token of A and one of B end together, a group
ends. Tokens whose byte ranges overlap are linked.

* Tokens: a text is cut before each single space between two characters that are no
  white space. Neither tokenizer joins across such a place, and both have a token
  end there, so equal parts have equal tokens and are encoded once while they are
  remembered. Other tokenizers encode whole texts.
* Merge path: the sorted ends of both are merged without a merge from the start.
  Diagonal binary searches find, for every ``width``-th step of the merge, how many
  ends of A and B lie before it. The pieces between are equal work and independent:
  all take a step at a time side by side, whatever texts they belong to. Each step
  is an overlap of two tokens, unless both have ended already, which a piece sees by
  the end before its first one. Group ends are numbered over the pieces afterwards,
  so a group that crosses pieces is whole.
* Counts: a slice of about 4 MB of texts names its different id pairs once, with the
  number of its documents that hold them. Their sums over the corpus go back to the
  slices that asked, not to each document, and not through the driver.

Null and empty texts, and texts whose tokens don't give back space and text, have no
tokens: zeros, an empty digest, no part in counts. Repeated rows count as documents
each. An empty table gives no rows. A very long text is merged in strips between safe
places. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, pieces, stored

by_value(__name__)

#: white space other than space and line feed, as Python (the widest definition in use here) has it
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]

#: fixed value: how byte-level tokenizers cut texts before merging
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def safe_parts(text: str) -> list[str]:
    """Parts of a text, cut at each space that has other characters than white space on both sides."""
    parts = text.split(" ")
    plain = not (
        "  " in text or " \n" in text or "\n " in text or text.startswith(" ") or text.endswith(" ")
    ) and not any(c in text for c in _OTHER_SPACE)
    if plain:
        return parts
    out = parts[:1]
    for part in parts[1:]:
        if part and out[-1] and not part[0].isspace() and not out[-1][-1].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


def segments(text: str, most: int) -> Iterator[str]:
    """A text cut at safe places after about ``most`` characters."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        while cut >= 0 and (cut + 1 == len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class Encoder:
    """Ids and byte lengths of the tokens of parts under both tokenizers; remembers about ``most`` bytes."""

    def __init__(self, a_path: str, b_path: str, most: int = 96 << 20):
        import json

        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as file:
            described = json.load(file)
        before = described.get("pre_tokenizer") or {}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.safe = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not any("▁" in p.lstrip("▁") for p in names)
        # byte-level vocabularies write a byte that isn't printable as the next free character from 256
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(printed)]
        byte = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(other)}
        self.a_bytes = [bytes(byte[c] for c in self.a.id_to_token(i) or "" if c in byte) for i in range(self.a.get_vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.sizes = [np.array(list(map(len, known)), np.int64) for known in (self.a_bytes, self.b_bytes)]
        self.spelling = [(np.frombuffer(b"".join(known), np.uint8), np.cumsum(n) - n) for known, n in zip((self.a_bytes, self.b_bytes), self.sizes, strict=True)]
        self.ranks = self._ranks(described) if self.safe else None
        self.most = most
        self.forget()

    def _ranks(self, described: dict):
        """The same merges by rank, a faster form for ASCII texts, where the ids follow the order of the merges."""
        import tiktoken

        model = described["model"]
        vocabulary, merges = model["vocab"], (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        in_order = all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
        known = {self.a_bytes[i]: i for i in vocabulary.values() if i < 256 + len(model["merges"])}
        if described.get("normalizer") or not in_order or len(known) != 256 + len(model["merges"]):
            return None
        return tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=known, special_tokens={})

    def trim(self):
        """Forget everything where too much is held; places got before are void."""
        if self.held > self.most:
            self.forget()

    def forget(self):
        import numpy as np

        self.known: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.start = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.held = 0

    def places(self, parts: list[str]):
        """Place of each part in the store; new parts are encoded."""
        import numpy as np

        fresh = set(parts) - self.known.keys()
        if fresh:
            joined = [p for p in fresh if self.safe and p and not (p[0].isspace() or p[-1].isspace() or "▁" in p)]
            ascii_, other = [p for p in joined if p.isascii()], [p for p in joined if not p.isascii()]
            for some, fast in ((ascii_, True), (other, False)):
                if some and not self._add_joined(some, fast):
                    joined = [p for p in joined if p.isascii() != fast]
            self._add_each(list(fresh.difference(joined)))
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def _add_joined(self, parts: list[str], fast: bool, size: int = 500) -> bool:
        """Encode parts that begin and end with no white space in long strings; False if the tokens don't give these back."""
        import numpy as np

        texts = [" ".join(parts[k : k + size]) for k in range(0, len(parts), size)]
        whole = np.frombuffer("".join([" " + t for t in texts]).encode(), np.uint8)
        close = np.cumsum([len(p) + 1 for p in parts] if fast else [len(p.encode()) + 1 for p in parts])
        if fast and self.ranks:
            ids = [self.ranks.encode_ordinary(" " + t) for t in texts]
        else:
            ids = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        found = []
        for side, lists in enumerate((ids, self.b.encode(texts, num_threads=1))):
            flat = np.concatenate([np.array(x, np.int32) for x in lists])
            ends = np.cumsum(self.sizes[side][flat])
            if not len(ends) or ends[-1] != len(whole) or not np.array_equal(self._spelt(side, flat, ends), whole):
                return False
            last = np.searchsorted(ends, close)
            if not np.array_equal(ends[last], close):
                return False
            found.append((flat, np.diff(last + 1, prepend=0)))
        self._add(parts, np.ones(len(parts), bool), found)
        return True

    def _spelt(self, side: int, ids, ends):
        """The bytes of the tokens one after another."""
        import numpy as np

        table, start = self.spelling[side]
        return table[np.arange(ends[-1]) + np.repeat(start[ids] - ends + self.sizes[side][ids], self.sizes[side][ids])]

    def _add_each(self, parts: list[str]) -> None:
        import numpy as np

        if not parts:
            return
        ids = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)], self.b.encode(parts, num_threads=1)
        good = [
            b"".join([self.a_bytes[i] for i in x]) == (b" " + p.encode()) == b"".join([self.b_bytes[i] for i in y]) for x, y, p in zip(*ids, parts, strict=True)
        ]
        self._add(parts, good, [(np.fromiter((i for x in own for i in x), np.int32), np.fromiter(map(len, own), np.int64, len(parts))) for own in ids])

    def _add(self, parts: list[str], good, found) -> None:
        import numpy as np

        self.known |= zip(parts, range(len(self.good), len(self.good) + len(parts)))
        self.good = np.append(self.good, good)
        for side, (flat, many) in enumerate(found):
            self.start[side] = np.append(self.start[side], self.start[side][-1] + np.cumsum(many))
            self.flat[side] = np.append(self.flat[side], flat)
            self.held += 4 * len(flat)
        self.held += 180 * len(parts) + sum(map(len, parts))

    def tokens(self, side: int, place):
        """Ids of all parts one after another, and the number of each part's."""
        import numpy as np

        first = self.start[side][place]
        many = self.start[side][place + 1] - first
        total = np.cumsum(many)
        at = np.repeat(first - total + many, many) + np.arange(total[-1] if len(total) else 0)
        return self.flat[side][at], many


def crossings(a, b, diagonals):
    """For each diagonal d the number of ends of A among the first d of both merged; A goes first in a tie."""
    import numpy as np

    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        right = a[np.minimum(mid, len(a) - 1)] <= b[np.clip(diagonals - 1 - mid, 0, len(b) - 1)]
        low, high = np.where(open_ & right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


def merge_path(a, b, width: int = 128):
    """Overlaps of the tokens of A and B from their sorted ends: (token of A, token of B, whether both end there)."""
    import numpy as np

    steps = len(a) + len(b)
    diagonals = np.arange(0, steps, width)
    i = crossings(a, b, diagonals)
    j = diagonals - i
    last = np.full(width + 1, np.iinfo(np.int64).max)
    ends_a, ends_b, before = np.concatenate([a, last]), np.concatenate([b, last]), np.concatenate([[-1], a, last])
    shape = (width, len(diagonals))
    at_a, at_b, link, common = np.empty(shape, np.int32), np.empty(shape, np.int32), np.empty(shape, bool), np.empty(shape, bool)
    for step in range(width):
        x, y = ends_a[i], ends_b[j]
        from_a = x <= y
        at_a[step], at_b[step] = i, j
        common[step] = x == y
        # a step over an end of B at which A ended one step before is no overlap
        link[step] = from_a | (before[i] != y)
        i, j = i + from_a, j + ~from_a
    link = link.T.ravel()[:steps]
    common = (common.T.ravel()[:steps])[link]
    return at_a.T.ravel()[:steps][link], at_b.T.ravel()[:steps][link], common


def _digits(n: int):
    """Decimal digits of 0 to n - 1 as a byte table, and their number."""
    import numpy as np

    values = np.arange(max(n, 1))
    width = len(str(max(n - 1, 0)))
    size = np.array([len(str(v)) for v in values.tolist()], np.int64)
    digits = np.zeros((width, len(values)), np.uint8)
    for k in range(width):
        digits[k] = 48 + values // 10 ** np.maximum(size - 1 - k, 0) % 10
    return digits, size


def group_text(ids_a, ids_b, group_a, group_b, digits):
    """Bytes ``a1,a2|b1;...;`` of all groups, and where each token of A begins in them."""
    import numpy as np

    table, size = digits
    n = len(ids_a) + len(ids_b)
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    count_a, count_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    place_a = np.arange(len(ids_a)) + (np.cumsum(count_b) - count_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(count_a)[group_b]
    ids, mark = np.empty(n, np.int32), np.full(n, 44, np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    close = np.cumsum(count_a + count_b)
    mark[close - 1] = 59
    mark[close - count_b - 1] = 124
    length = size[ids]
    start = np.cumsum(length + 1) - length - 1
    out = np.empty(int(length.sum()) + n, np.uint8)
    out[start + length] = mark
    for k in range(len(table)):
        some = np.flatnonzero(length > k) if k else slice(None)
        out[start[some] + k] = table[k][ids[some]]
    return out, start[place_a]


class _Document:
    __slots__ = ("counts", "digest", "keys", "times")

    def __init__(self):
        import hashlib

        self.counts, self.digest, self.keys, self.times = [0, 0, 0, 0], hashlib.sha256(), [], []


def _strip(encoder: Encoder, work: list[tuple[_Document, object]], digits) -> None:
    """Merge the ends of some (document, places of its parts) and add what comes out to the documents."""
    import numpy as np

    many = np.array([len(p) for _, p in work])
    place = np.concatenate([p for _, p in work])
    of_part = np.repeat(np.arange(len(work)), many)
    (ids_a, part_a), (ids_b, part_b) = encoder.tokens(0, place), encoder.tokens(1, place)
    ends_a, ends_b = np.cumsum(encoder.sizes[0][ids_a]), np.cumsum(encoder.sizes[1][ids_b])
    at_a, at_b, common = merge_path(ends_a, ends_b)
    of_a = np.repeat(of_part, part_a)
    n_a = np.bincount(of_part, part_a, len(work)).astype(np.int64)
    n_b = np.bincount(of_part, part_b, len(work)).astype(np.int64)
    group = np.cumsum(common) - common  # over all pieces: groups that cross them are one
    group_a, group_b = np.empty(len(ids_a), np.int64), np.empty(len(ids_b), np.int64)
    group_a[at_a], group_b[at_b] = group, group
    text, start = group_text(ids_a, ids_b, group_a, group_b, digits)
    edge = np.append(start[np.cumsum(n_a) - n_a], len(text))
    of_link = of_a[at_a]
    n_links = np.bincount(of_link, minlength=len(work))
    n_groups = np.bincount(of_link, common, len(work)).astype(np.int64)
    space = len(encoder.a_bytes) * len(encoder.b_bytes)
    keys = of_link * space + ids_a[at_a].astype(np.int64) * len(encoder.b_bytes) + ids_b[at_b]
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(first, append=len(keys))
    keys = keys[first]
    cut = np.searchsorted(keys, np.arange(len(work) + 1) * space)
    for k, (doc, _) in enumerate(work):
        if any(doc.counts):
            doc.digest.update(b";")
        doc.digest.update(text[edge[k] : edge[k + 1] - 1])
        doc.counts = [x + int(y) for x, y in zip(doc.counts, (n_a[k], n_b[k], n_groups[k], n_links[k]), strict=True)]
        doc.keys.append(keys[cut[k] : cut[k + 1]] - k * space)
        doc.times.append(times[cut[k] : cut[k + 1]])


def _sums(keys: list, times: list):
    """Different keys in order with the sums of their times."""
    import numpy as np

    if len(keys) == 1:
        return keys[0], times[0]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unique, back = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(back, np.concatenate(times), len(unique)).astype(np.int64)


def _whole(encoder: Encoder, work: list[tuple[_Document, list[str]]], digits) -> None:
    """Encode the parts of some documents together, and merge those whose tokens give back the text."""
    import itertools

    import numpy as np

    encoder.trim()
    place = encoder.places(list(itertools.chain.from_iterable(p for _, p in work)))
    cuts = np.cumsum([len(p) for _, p in work])[:-1]
    kept = [(doc, own) for (doc, _), own in zip(work, np.split(place, cuts), strict=True) if encoder.good[own].all()]
    if kept:
        _strip(encoder, kept, digits)


def _fits(encoder: Encoder, parts: list[str]) -> bool:
    encoder.trim()
    place = encoder.places(parts)
    return bool(encoder.good[place].all())


def _align(a_path: str, b_path: str, strip: int, slice_bytes: int):
    """A row per document with places of its pairs in the slice's list, and a row per slice with that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import numpy as np
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(a_path, b_path)
        digits = _digits(max(len(encoder.a_bytes), len(encoder.b_bytes)))
        split = safe_parts if encoder.safe else lambda t: [t]
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(pieces(batches, "text", slice_bytes)):
            docs, work, size = [], [], 0
            for text in batch.column("text").to_pylist():
                docs.append(_Document())
                if not text:
                    continue
                cut = list(segments(text, strip)) if encoder.safe else [text]
                if work and (len(cut) > 1 or size + len(text) > strip):
                    _whole(encoder, work, digits)
                    work, size = [], 0
                if len(cut) == 1:
                    work.append((docs[-1], split(text)))
                    size += len(text)
                elif all(_fits(encoder, split(s)) for s in cut):
                    for segment in cut:
                        _whole(encoder, [(docs[-1], split(segment))], digits)
            if work:
                _whole(encoder, work, digits)
            found = [_sums(d.keys, d.times) for d in docs]
            keys = [k for k, _ in found if len(k)]
            known, held = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
            place = np.searchsorted(known, np.concatenate([np.zeros(0, np.int64), *keys]))
            edge = np.cumsum([0] + [len(k) for k, _ in found] + [0]).astype(np.int32)
            times = np.concatenate([np.zeros(0, np.int64), *(t for _, t in found)])
            n = len(docs)
            none = pa.nulls(1, pa.int64())
            counts = np.array([d.counts for d in docs], np.int64).reshape(n, 4)
            own = [0] * n + [len(known)]
            lists = lambda flat, many: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.array(flat.astype(np.int32)))
            per_doc = np.diff(edge)
            per_doc[-1] = 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, (part << 32) + number), pa.int64()), pa.array([False] * n + [True]),
                    pa.concat_arrays([batch.column("id"), pa.nulls(1, batch.column("id").type)]),
                    *(pa.concat_arrays([pa.array(counts[:, c]), none]) for c in range(4)),
                    pa.array([d.digest.hexdigest() if any(d.counts) else "" for d in docs] + [None], pa.string()),
                    lists(place, per_doc), lists(times, per_doc),
                    lists(known // len(encoder.b_bytes), own), lists(known % len(encoder.b_bytes), own), lists(held, own),
                ],
                names=[f.name for f in _FIELDS],
            )

    return run


_FIELDS = [
    T.StructField("slice", T.LongType()), T.StructField("is_slice", T.BooleanType()), T.StructField("id", T.LongType()),
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()), T.StructField("place", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType())),
    T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType())), T.StructField("held", T.ArrayType(T.IntegerType())),
]


def _answered(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over the links of each document of one slice, from the counts of the slice's pairs."""
    import numpy as np
    import pyarrow.compute as pc

    n = answers.num_rows
    count, best = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    at = answers["pos"].to_numpy()
    count[at], best[at] = answers["held"].to_numpy(), answers["is_best"].to_numpy()
    many = pc.list_value_length(docs["place"]).to_numpy()
    row = np.repeat(np.arange(docs.num_rows), many)
    place = pc.list_flatten(docs["place"]).to_numpy()
    times = pc.list_flatten(docs["times"]).to_numpy().astype(np.int64)

    def summed(values):
        out = np.zeros(docs.num_rows, np.int64)
        np.add.at(out, row, values)
        return pa.array(out)

    out = docs.select(["id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", summed(times * best[place])).append_column("count_sum", summed(times * count[place])).append_column("groups_sha256", docs["groups_sha256"])


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", strip: int = 1 << 20, slice_bytes: int = 4 << 20) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row.

    A pair of ids counts once for each document in which it is linked. ``n_best`` are the
    links whose count is the highest of their id of A, ``count_sum`` sums over all links.
    Both files must be readable by every executor, as an installed package is.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType
    fields = [T.StructField("id", kind) if f.name == "id" else f for f in _FIELDS]
    found = stored(texts.mapInArrow(_align(a_path, b_path, strip, slice_bytes), T.StructType(fields)), "aligned")
    asked = found.where("is_slice").selectExpr("slice", "posexplode(arrays_zip(a, b, held)) as (pos, x)").selectExpr("slice", "pos", "x.a as a", "x.b as b", "x.held as n")
    counts = stored(asked.groupBy("a", "b").agg(F.sum("n").alias("held")), "pair_counts")
    # at most as many rows per id as the other vocabulary has
    counts = counts.withColumn("is_best", (F.col("held") == F.max("held").over(Window.partitionBy("a"))).cast("bigint"))
    answers = asked.join(counts, ["a", "b"]).select("slice", "pos", "held", "is_best")
    rows = found.where("not is_slice").select(F.col("slice").alias("s"), "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "place", "times")
    out = T.StructType(
        [T.StructField("id", kind)] + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [T.StructField("groups_sha256", T.StringType())]
    )
    summed = rows.groupBy("s").cogroup(answers.groupBy("slice")).applyInArrow(_answered, out)
    return summed.withColumnRenamed("id", id_col)
