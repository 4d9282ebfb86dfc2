"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols (insult I, weak insult W, threat T, target Y, negation N, reporting R, other O,
clause end E). Three small deterministic transducers rewrite the symbols, one after
another: negation lowers an insult or threat within a few words after a negation,
reported speech marks what a clause only reports, and the clause transducer emits one
pattern per hit, with or without a target in the clause. ``compose`` joins them into
one machine, so a clause costs one table look-up a word. What counts is the matched
clause pattern: a target, negation or reporting word alone emits nothing.

Fitting uses a sample of labelled rows, ``sample`` of them at most, chosen by a hash
of the id. It extends the seed words by words and word stems that are several times as
frequent in toxic texts, strong and weak ones apart (``lexicon``), sets the
weight of each number of matches of a kind from its log odds, and calibrates the score.
Negated and reported matches count less, matches with a target in their clause more. Everything else covers all rows and whole texts.

Null and empty texts have no patterns; their score is the calibrated base rate of
such texts. Rows with a null id are scored, are not held out and are not learnt from.
If an id has several labels the toxic one counts. Without labelled rows of both kinds
the seed words and default weights are used. Other columns are ignored. Texts over
1 MiB are read in stretches cut at a clause end, or else a blank, in their last part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, packed, pieces, quoted, stored, unpacked

by_value(__name__)

#: seed words of the grammar; fixed values
SEEDS = {
    "I": "idiot moron stupid loser trash scum pathetic worthless disgusting clown fool imbecile dumb",
    "T": "kill hurt destroy beat burn shoot stab hang smash",
    "Y": "you your yours u he him she her they them their du dich dir ihr sie tu te toi vous lui tú usted ustedes ellos",
    "N": "not never no none neither nor without isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun nunca ni sin",
    "R": "said says say wrote writes called calls quoted quotes claimed claims reported according sagte sagt schrieb dit écrit selon dijo dice según",
}
#: what one match of a pattern counts: less if negated or reported, more with a target in its clause
COUNTS = {
    f"{k}{t}": round(n + 0.25 * bool(t), 2)
    for k, n in {"I": 1.0, "i": 0.5, "J": 0.75, "j": 0.4, "W": 1.0, "w": 0.5, "V": 0.75, "v": 0.4, "T": 1.0, "t": 0.5, "S": 0.75, "s": 0.4}.items()
    for t in ("", "+")
}
_KIND = {p: {"I": "I", "J": "I", "W": "W", "V": "W", "T": "T", "S": "T"}[p[0].upper()] for p in COUNTS}
#: weight of one match of each kind before any label is seen
DEFAULTS = {"I": 2.5, "W": 0.8, "T": 3.0}
_MANY = 4  # matches of one kind that weigh alike from here on
_REACH = 3  # words a negation reaches forward
_STRETCH = 1 << 20
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]")
_END = frozenset(".!?;:\n")

# --- transducers: table[(state, symbol)] = (next state, emitted symbols); start state 0


def negation() -> dict:
    out = {}
    for state in range(_REACH + 1):
        after = max(0, state - 1)
        for s in "OYR":
            out[state, s] = (after, s)
        for s in "IWT":
            out[state, s] = (after, s.lower() if state else s)
        out[state, "N"] = (_REACH, "O")
        out[state, "E"] = (0, "E")
    return out


def reporting() -> dict:
    marked = {"I": "J", "i": "j", "W": "V", "w": "v", "T": "S", "t": "s"}
    out = {}
    for state in (0, 1):
        for s in "OY":
            out[state, s] = (state, s)
        for s, m in marked.items():
            out[state, s] = (state, m if state else s)
        out[state, "R"] = (1, "O")
        out[state, "E"] = (0, "E")
    return out


def clauses() -> dict:
    """States: 0 nothing yet, 1 a target was seen, or the pattern that waits for a target."""
    hits = "IiJjWwVvTtSs"
    out: dict = {}
    for state in (0, 1, *hits):
        waits = state if isinstance(state, str) else ""
        out[state, "O"] = (state, ())
        out[state, "E"] = (0, (waits,) if waits else ())
        out[state, "Y"] = (1, (waits + "+",) if waits else ())
        for s in hits:
            out[state, s] = (1, (s + "+",)) if state == 1 else (s, (waits,) if waits else ())
    return out


def compose(first: dict, second: dict) -> dict:
    """The machine that feeds what ``first`` emits, one symbol a step, to ``second``."""
    out, open_, seen = {}, [(0, 0)], {(0, 0)}
    symbols = {s for _, s in first}
    while open_:
        a, b = open_.pop()
        for s in symbols:
            a2, emitted = first[a, s]
            b2, result = second[b, emitted]
            out[(a, b), s] = ((a2, b2), result)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                open_.append((a2, b2))
    names = {state: i for i, state in enumerate(sorted(seen, key=lambda x: (x != (0, 0), repr(x))))}
    return {(names[state], s): (names[after], r) for (state, s), (after, r) in out.items()}


@dataclass
class Grammar:
    """Word and stem symbols, pattern weights and calibration."""

    words: dict[str, str] = field(default_factory=lambda: {w: k for k, ws in SEEDS.items() for w in ws.split()})
    stems: dict[str, str] = field(default_factory=dict)
    weights: dict[tuple[str, int], float] = field(default_factory=lambda: {(k, n): w * math.log2(1 + n) for k, w in DEFAULTS.items() for n in range(_MANY + 1)})
    slope: float = 1.0
    base: float = -2.5

    def score(self, patterns: Counter) -> float:
        x = self.base + self.slope * self.evidence(patterns)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def evidence(self, patterns: dict[str, int]) -> float:
        """Weights of the counts per kind, between whole numbers on a straight line."""
        total = 0.0
        for kind, n in counts(patterns).items():
            low = min(int(n), _MANY)
            high = min(low + 1, _MANY)
            total += self.weights[kind, low] + (n - low) * (self.weights[kind, high] - self.weights[kind, low])
        return total


def counts(patterns: dict[str, int]) -> dict[str, float]:
    out: dict[str, float] = {}
    for p, n in patterns.items():
        out[_KIND[p]] = min(_MANY, out.get(_KIND[p], 0.0) + n * COUNTS[p])
    return out


class Matcher:
    """Counts the patterns of a text; remembers the symbols of words it has met."""

    def __init__(self, grammar: Grammar):
        self.words, self.stems = grammar.words, grammar.stems
        self.lengths = sorted({len(s) for s in self.stems})
        self.machine = compose(compose(negation(), reporting()), clauses())
        self.known: dict[str, str] = {}

    def symbol(self, word: str) -> str:
        found = self.known.get(word)
        if found is None:
            found = "E" if word in _END else self.words.get(word) or next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), "O")
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = found
        return found

    def patterns(self, text: str) -> Counter:
        found: Counter = Counter()
        state, machine, symbol = 0, self.machine, self.symbol
        for part in stretches(text.lower()):
            tokens = _TOKEN.findall(part)
            if not any(symbol(w) in "IWT" for w in set(tokens)):
                found.update(machine[state, "E"][1])
                state = 0
                continue
            for word in tokens:
                state, emitted = machine[state, symbol(word)]
                if emitted:
                    found.update(emitted)
        found.update(machine[state, "E"][1])
        return found


def stretches(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = min(len(text), at + _STRETCH)
        if end < len(text):
            low = end - _STRETCH // 8
            cut = max(text.rfind(c, low, end) for c in "\n.!?;")
            cut = cut if cut > low else text.rfind(" ", low, end)
            end = cut + 1 if cut > low else end
        yield text[at:end]
        at = end


# --- fitting

_STEM = range(3, 13)
_LEAST_GAIN = 7 * math.log(10)
_MOST_COUNTED = 1 << 18  # features a task counts before it hands them on


def _features(text: str) -> set[str]:
    """Words, marked by a final $, and their stems."""
    words = {w for part in stretches(text.lower()) for w in _TOKEN.findall(part)} - _END
    return {w + "$" for w in words} | {w[:n] for w in words for n in _STEM if n <= len(w)}


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (feature, n_toxic, n_clean), several for a feature where a task holds many different ones."""

    def rows() -> pa.RecordBatch:
        every = list(toxic.keys() | clean.keys())
        columns = [pa.array(every, pa.string()), *(pa.array([c[f] for f in every], pa.int64()) for c in (toxic, clean))]
        return pa.RecordBatch.from_arrays(columns, names=["feature", "n_toxic", "n_clean"])

    toxic: Counter = Counter()
    clean: Counter = Counter()
    for batch in pieces(batches, "text"):
        for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            (toxic if label else clean).update(_features(text or ""))
            if len(toxic) + len(clean) > _MOST_COUNTED:
                yield rows()
                toxic.clear()
                clean.clear()
    yield rows()


def _candidates(train: DataFrame, n_toxic: int, n_clean: int, least: int, odds: float) -> tuple[dict[str, int], dict[str, int]]:
    """Toxic and clean texts that hold a feature, for all features that ``lexicon`` may take (its conditions, less a margin for rounding)."""
    counted = train.where("toxic in (0, 1)").select("toxic", "text").mapInArrow(_count_features, "feature string, n_toxic bigint, n_clean bigint")
    total = counted.groupBy("feature").agg(F.sum("n_toxic").alias("n"), F.sum("n_clean").alias("c")).where(F.col("n") >= least)
    rated = total.withColumn("r", (F.col("n") + 0.5) / F.lit(n_toxic + 1.0) / ((F.col("c") + 0.5) / F.lit(n_clean + 1.0)))
    rated = rated.where(F.col("r") >= odds / 5 * (1 - 1e-9)).where(F.col("n") * F.log("r") - F.col("n") + F.col("n") / F.col("r") >= _LEAST_GAIN - 1e-6)
    found = rated.select("feature", "n", "c").collect()
    return {x["feature"]: x["n"] for x in found}, {x["feature"]: x["c"] for x in found}


def lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, odds: float) -> tuple[dict[str, str], dict[str, str]]:
    """Words and stems with their symbol: W if ``odds`` / 5 times as frequent in toxic texts, I if
    3 * ``odds`` times even with two more clean texts.

    Of the stems of a word, and the word itself, the one whose counts are the least
    likely by chance is taken, and none that it begins with or that begins with it.
    Chance alone would bring up one feature in ten million.
    """

    def ratio(f: str) -> float:
        return (toxic[f] + 0.5) / (n_toxic + 1) / ((clean.get(f, 0) + 0.5) / (n_clean + 1))

    def gain(f: str) -> float:
        n, r = toxic[f], ratio(f)
        return n * math.log(r) - n + n / r if r >= odds / 5 else 0.0

    gains = {f: g for f in toxic if (g := gain(f)) >= _LEAST_GAIN}
    words: dict[str, str] = {}
    stems: dict[str, str] = {}
    begun: set[str] = set()
    for f in sorted(gains, key=lambda f: (-gains[f], f.endswith("$"), -len(f), f)):
        if f in begun or any(f[:n] in stems for n in _STEM if n < len(f)) or f.endswith("$") and any(f[:n] in begun for n in (len(f) - 1,)):
            continue
        (words if f.endswith("$") else stems)[f.rstrip("$")] = "I" if ratio(f) * (clean.get(f, 0) + 0.5) >= 3 * odds * (clean.get(f, 0) + 2) else "W"
        begun.update(f[:n] for n in _STEM if n < len(f) + 1)
    return words, stems


def _vectors(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(grammar)
        for batch in pieces(batches, "text"):
            found = [matcher.patterns(t or "") for t in batch.column("text").to_pylist()]
            keys = [" ".join(f"{p}:{min(n, 8)}" for p, n in sorted(c.items())) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(keys, pa.string())], names=["toxic", "patterns"])

    return run


def calibrate(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and base of a logistic curve through (x, clean, toxic) counts; slightly shrunk."""
    slope, base = 0.5, -1.0
    for _ in range(60):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, clean, toxic in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, base + slope * x))))
            n = clean + toxic
            g0 += toxic - n * p
            g1 += (toxic - n * p) * x
            w = n * p * (1 - p)
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        g0, g1, h00, h11 = g0 - 0.02 * base, g1 - 0.1 * slope, h00 + 0.02, h11 + 0.1
        det = h00 * h11 - h01 * h01
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 2.0 / max(abs(d0), abs(d1), 1e-12))
        base, slope = base + step * d0, max(0.01, slope + step * d1)
        if max(abs(d0), abs(d1)) < 1e-9:
            break
    return slope, base


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000,
        least: int = 5, odds: float = 20.0) -> Grammar:
    """Fit on at most ``sample`` labelled rows; pass only rows that may be learnt from."""
    known = labels.where(f"{id_col} is not null and {label_col} is not null").groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # sample rows at most: small enough to broadcast
    train = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("toxic", "text"), "train")
    grammar = Grammar()
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return grammar
    toxic, clean = _candidates(train, n_toxic, n_clean, least, odds)
    words, grammar.stems = lexicon(toxic, clean, n_toxic, n_clean, odds)
    grammar.words = words | grammar.words
    seen = train.mapInArrow(_vectors(grammar), "toxic int, patterns string").groupBy("patterns").agg(
        F.sum(F.expr("int(toxic = 0)")).alias("clean"), F.sum(F.expr("int(toxic = 1)")).alias("toxic")
    )
    rows = [({k: int(v) for k, v in (p.split(":") for p in r["patterns"].split())}, r["clean"], r["toxic"]) for r in seen.collect()]
    binned = [({k: max(1, round(n)) for k, n in counts(v).items()}, c, t) for v, c, t in rows]
    for kind in DEFAULTS:
        before = 0.0
        for n in range(1, _MANY + 1):
            few = 1.0 / (n_clean + 1)
            pos = sum(t for v, _, t in binned if v.get(kind) == n) / (n_toxic + 1)
            neg = sum(c for v, c, _ in binned if v.get(kind) == n) / (n_clean + 1)
            before = grammar.weights[kind, n] = max(before, math.log((pos + few * math.exp(grammar.weights[kind, n])) / (neg + few)))
    points = [(grammar.evidence(v), c, t) for v, c, t in rows]
    grammar.slope, grammar.base = calibrate(points)
    return grammar


def _score(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(grammar)
        for batch in pieces(batches, "text"):
            found = [matcher.patterns(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([grammar.score(c) for c in found], pa.float64()), pa.array([sum(c.values()) for c in found], pa.int64())],
                names=["id", "score", "n_patterns"],
            )

    return run


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score (0 to 1), n_patterns (matched clause patterns), predicted (1 from ``threshold`` on) per row."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    out = texts.mapInArrow(_score(grammar), f"id {kind}, score double, n_patterns bigint")
    return out.select(F.col("id").alias(id_col), "score", "n_patterns", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _added(grammar: Grammar, text_col: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(grammar)
        for batch in pieces(batches, text_col):
            found = [grammar.score(matcher.patterns(t or "")) for t in batch.column(text_col).to_pylist()]
            yield batch.append_column(name, pa.array(found, pa.float64()))

    return run


def clean(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, all columns as they are."""
    rows = packed(docs, text=quoted(text_col))
    scored = rows.mapInArrow(_added(grammar, "text", "score"), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.where(F.col("score") < threshold).select(*unpacked(scored, docs.columns))


def is_held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
