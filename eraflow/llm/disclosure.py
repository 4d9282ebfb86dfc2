"""Personal data in texts, and the terms around it that give it away.

Base spans are e-mail addresses, IP addresses, card and phone numbers by fixed
patterns, found in one pass over a text in linear time. Each different value is an
entity to protect.

Information-theoretic sanitisation adds terms. The information that a term t gives
about an entity c is PMI(c; t) = log2 p(c, t) / (p(c) p(t)); knowing t, IC(c) - PMI(c; t)
= -log2 p(c | t) bits of c stay unknown. Both are estimated from the corpus: ``near``
counts the different texts with t within ``window`` terms of a mention of c, ``all`` the
different texts with t. A term with ``support`` such texts that leaves no more than
``residual_bits`` (under 1, so a term reveals one entity at most) exceeds the threshold.
It is generalised to the first half of its characters, with digits as 0, if that form
leaves more bits than the threshold, and else removed. This holds for all its places in
the documents that hold the entity; other documents keep the term, as it can't be tied
to a value that is gone everywhere. Equal texts count once in the estimates.

Counts are over all texts; no list of them is held by one task. The 8 MiB bit filters
only spare terms, exact joins follow.

Null and empty texts hold nothing. Repeated rows each get their spans. An empty table
gives no rows. Very long texts are read whole, in linear time. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_filter, by_value, passes, pieces, stored
from .terms import Sieve, term_lists

by_value(__name__)

KINDS = ("email", "ip", "card", "phone", "term")

#: fixed values: the patterns of the base kinds
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".") if "." in chain.group() else ()
        at = chain.start()
        for k in range(0, len(parts) - len(parts) % 4, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            # a part counts by its value, whatever zeros it begins with
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def _luhn(digits: str) -> bool:
    double = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in double)) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for chain in _SPACED.finditer(text):
        if chain.end() - chain.start() >= 16:
            digits = chain.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                yield chain.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, match.group())) <= 15:
            yield match.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [(0, *span) for span in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *span) for span in _addresses(text)]
        out += [(2, *span) for span in _cards(text)]
        if "+" in text:
            out += [(3, *span) for span in _phones(text)]
    return out


def entity(kind: int, value: str) -> str:
    """One name for the spellings of a value."""
    if kind == 0:
        value = value.lower()
    elif kind == 1:
        value = ".".join(str(int(p.lstrip("0") or 0)) for p in value.split("."))
    else:
        value = "".join(filter(str.isdigit, value))
    return f"{KINDS[kind]}:{value}"


def lowered(word: str) -> str:
    return word.lower() if word.isascii() else word.encode().lower().decode()


def general(term: str) -> str:
    """The general form of a term: the first half of its characters, digits as 0; no term looks like one."""
    half = term[: (len(term) + 1) // 2]
    return re.sub("[0-9]", "0", half) + "*"


def _general_bytes(term: bytes) -> bytes:
    return general(term.decode("utf-8", "replace")).encode()


def neighbours(text: str, spans: list[tuple[int, int, int]], window: int) -> dict[str, set[str]]:
    """For each entity of a text the terms within ``window`` terms of a mention, none inside base spans."""
    covered = sorted((b, e) for _, b, e in spans)
    out: dict[str, set[str]] = {}
    for kind, start, end in spans:
        near = out.setdefault(entity(kind, text[start:end]), set())
        # terms before: from a place that surely has enough of them, further back if not
        back, words = 64 * window, []
        while True:
            at = max(0, start - back)
            words = list(_TERM.finditer(text, at, start))
            if at and words and words[0].start() == at and _TERM.match(text, at - 1):
                words = words[1:]  # cut inside
            if at == 0 or len(words) >= window:
                break
            back *= 4
        words = words[-window:]
        after = _TERM.finditer(text, end)
        words += [w for w, _ in zip(after, range(window), strict=False)]
        near |= {lowered(w.group()) for w in words if not _inside(covered, w.start(), w.end())}
    return out


def _inside(covered: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a range overlaps one of the sorted ranges (each kind's own don't overlap; kinds may)."""
    import bisect

    at = bisect.bisect_left(covered, (end, 0))
    return any(e > start for _, e in covered[max(0, at - 4) : at])


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for k, b, e in spans)


def _found(window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", most):
            counts, joined, entities, terms = [], [], [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text) if text else []
                near = neighbours(text, spans, window) if spans else {}
                counts.append([sum(k == kind for k, _, _ in spans) for kind in range(4)])
                joined.append(_joined(spans))
                entities.append(list(near))
                terms.append([{"entity": c, "term": t, "general": general(t)} for c, own in near.items() for t in sorted(own)])
            keep = [batch.column(c) for c in ("id", "row", "key")]
            yield pa.RecordBatch.from_arrays(
                [*keep, *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(joined, pa.string()),
                 pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.struct([(n, pa.string()) for n in ("entity", "term", "general")])))],
                names=["id", "row", "key", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "entities", "near"],
            )

    return run


def _holders(held, copied, most: int):
    """Per text: the different terms, and general forms of its terms, that pass the filter.

    The key stays only where the text may have copies: other texts need none to count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        import numpy as np

        exact, wide = Sieve(held.value), Sieve(held.value, _general_bytes)
        for batch in pieces(batches, "text", most):
            out = []
            for text in batch.column("text").to_pylist():
                own: set[bytes] = set()
                for words in term_lists(text or b""):
                    words = set(words)
                    for sieve in (exact, wide):
                        yes = sieve.look(words)
                        own.update(map(yes.__getitem__, words & yes.keys()))
                out.append(own)
            flat = pa.array(list(itertools.chain.from_iterable(out)), pa.binary()).cast(pa.string())
            ends = pa.array(list(itertools.accumulate(map(len, out), initial=0)), pa.int32())
            key = batch.column("key").to_numpy()
            keys = pa.array(key, mask=~passes(copied.value, key.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, flat)], names=["key", "terms"])

    return run


def _places(held, most: int):
    """row, key, term, starts, ends of terms that pass the filter, in texts with base spans and outside of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve(held.value)
        for batch in pieces(batches, "text", most):
            out = {"row": [], "key": [], "term": [], "starts": [], "ends": []}
            rows, keys = batch.column("row").to_pylist(), batch.column("key").to_pylist()
            for k, text in enumerate(batch.column("text").to_pylist()):
                spans = base_spans(text) if text else []
                if not spans:
                    continue
                yes: set[bytes] = set()
                for words in term_lists(text.encode()):
                    words = set(words)
                    yes |= words & sieve.look(words).keys()
                if not yes:
                    continue
                covered = sorted((b, e) for _, b, e in spans)
                at: dict[str, list] = {}
                for word in _TERM.finditer(text):
                    low = lowered(word.group())
                    if low.encode() in yes and not _inside(covered, *word.span()):
                        at.setdefault(low, []).append(word.span())
                for term, own in at.items():
                    for name, value in zip(out, (rows[k], keys[k], term, [b for b, _ in own], [e for _, e in own]), strict=True):
                        out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


def revealing(docs: DataFrame, found: DataFrame, residual_bits: float = 0.5, support: int = 3, batch_bytes: int = 4 << 20) -> DataFrame:
    """term, entity, action (generalise or remove), general, p: the terms over the threshold."""
    if not 0 <= residual_bits < 1:
        raise ValueError("residual_bits: at least 0, under 1")
    least = 2.0**-residual_bits
    near = found.select("key", F.explode("near").alias("x")).select("key", "x.*")
    forms = near.select("key", "entity", "term").union(near.select("key", "entity", "general"))
    pairs = forms.distinct().groupBy("entity", "term").agg(F.count("*").alias("near")).where(F.col("near") >= support)
    pairs = stored(pairs, "near_terms")
    asked = pairs.select("term").distinct()
    held = bit_filter(asked.select(F.xxhash64("term").alias("h")), "h")
    texts = docs.select("key", F.col("text").cast("binary").alias("text"))
    copied = bit_filter(found.groupBy("key").count().where("count > 1"), "key")
    holders = texts.mapInArrow(_holders(held, copied, batch_bytes), "key bigint, terms array<string>")
    total = holders.select("key", F.explode("terms").alias("term")).groupBy("term", "key").agg(F.count("*").alias("n"))
    total = total.groupBy("term").agg(F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(1)).alias("all"))
    risky = stored(pairs.join(total, "term").withColumn("p", F.col("near") / F.col("all")).where(F.col("p") >= least), "risky_terms")
    wide = risky.where("term like '%*'").select("entity", F.col("term").alias("general"), F.lit(True).alias("told"))
    known = near.select("entity", "term", "general").distinct()
    terms = risky.where("term not like '%*'").join(known, ["entity", "term"]).join(wide, ["entity", "general"], "left")
    return terms.select("term", "entity", F.when(F.col("told"), "remove").otherwise("generalise").alias("action"), "general", "p")


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, residual_bits: float = 0.5, support: int = 3,
                  batch_bytes: int = 4 << 20) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, n_terms, base_spans and term_spans as text, terms
    (start, end, term, action, general), and row and key, two hashes that name the row.

    Spans are ``kind:start:end`` in code points, by kind and start, joined by commas.
    """
    texts = _keyed(docs, id_col, text_col)
    schema = T.StructType(
        [texts.schema["id"], T.StructField("row", T.LongType()), T.StructField("key", T.LongType())]
        + [T.StructField(n, T.LongType()) for n in ("n_email", "n_ip", "n_card", "n_phone")]
        + [T.StructField("base_spans", T.StringType()), T.StructField("entities", T.ArrayType(T.StringType()))]
        + [T.StructField("near", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("entity", "term", "general")])))]
    )
    found = stored(texts.mapInArrow(_found(window, batch_bytes), schema), "base_spans")
    reveal = stored(revealing(texts, found, residual_bits, support, batch_bytes), "revealing")
    held = bit_filter(reveal.select(F.xxhash64("term").alias("h")), "h")
    places = texts.select("row", "key", "text").mapInArrow(_places(held, batch_bytes), "row bigint, key bigint, term string, starts array<int>, ends array<int>")
    places = stored(places.dropDuplicates(["row", "key", "term"]), "places")
    mentions = stored(found.select("row", "key", F.explode("entities").alias("entity")).distinct(), "mentions")
    hits = places.join(reveal, "term").join(mentions, ["row", "key", "entity"], "left_semi")
    one = hits.selectExpr("row as r", "key as k", "inline(arrays_zip(starts, ends))", "term", "action", "general").selectExpr(
        "r", "k", "named_struct('start', starts, 'end', ends, 'term', term, 'action', action, 'general', general) as x"
    )
    terms = one.groupBy("r", "k").agg(F.sort_array(F.collect_list("x")).alias("terms"))
    out = found.join(terms, (F.col("row") == F.col("r")) & (F.col("key") == F.col("k")), "left")
    return out.select(
        F.col("id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", F.greatest(F.lit(0), F.coalesce(F.size("terms"), F.lit(0))).cast("bigint").alias("n_terms"),
        "base_spans", F.expr("concat_ws(',', transform(terms, x -> concat('term:', x.start, ':', x.end)))").alias("term_spans"), "terms", "row", "key",
    )


def _cleaned(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", most):
            out = []
            for text, terms in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                if not text:
                    out.append(text)
                    continue
                cuts = [(b, e, f"[{KINDS[k].upper()}]") for k, b, e in base_spans(text)]
                cuts += [(t["start"], t["end"], t["general"] if t["action"] == "generalise" else "[TERM]") for t in terms or []]
                done, last = [], 0
                for start, end, put in sorted(cuts):
                    if start >= last:
                        done += [text[last:start], put]
                    last = max(last, end)  # kinds may overlap: the first names the place
                out.append("".join([*done, text[last:]]))
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string())).drop_columns(["terms"])

    return run


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20, **options) -> DataFrame:
    """The rows of ``docs`` with base spans masked and revealing terms generalised or removed; null texts stay null."""
    spans = private_spans(docs, id_col, text_col, batch_bytes=batch_bytes, **options).where("n_terms > 0").select("row", "key", "terms").dropDuplicates(["row", "key"])
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(
        F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(others)]).alias("others") if others else F.lit(None).alias("others"),
        F.col(f"`{text_col}`").alias("text"), F.xxhash64(id_col, text_col).alias("row"), F.xxhash64(text_col).alias("key"),
    )
    joined = packed.join(spans, ["row", "key"], "left").select("others", "text", "terms")
    clean = joined.mapInArrow(_cleaned(batch_bytes), T.StructType([joined.schema["others"], joined.schema["text"]]))
    at = {c: F.col(f"others.c{k}").alias(c) for k, c in enumerate(others)}
    return clean.select(*[at.get(c, F.col("text").alias(c)) for c in docs.columns])
