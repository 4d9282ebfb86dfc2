"""Ranked search against scores of every pair."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from eraflow.llm import dualtree
from eraflow.llm.terms import digest, term_lists

from .data import docs, empty, rows_of, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, items, k=10):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    bags = [(i, c) for i, c in bags if c]
    n_docs, n_terms = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in bags:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(TERM.findall((text or "").translate(LOWER))) if c[t]
            )
            if score:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def queries(rows, seed=2):
    rng = random.Random(seed)
    long = [t for _, t in rows if t and len(t.split()) > 8]
    items = [(k, " ".join(rng.choice(long).split()[3:30])) for k in range(40)]
    return items + [(3, items[3][1]), (3, "alpha1 beta2"), (50, ""), (51, None), (52, "nowhere at all"), (None, long[0]), (53, "ALPHA1, é ééé")]


def asked(spark, items):
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    return frame.withColumn("score", F.lit(1)).withColumn("doc_id", F.lit("x"))


def test_terms():
    text = "Ab1.éÀ-c_d 中文\x00z" * 50
    assert [w.decode() for part in term_lists(text.encode(), 16) for w in part] == TERM.findall(text.translate(LOWER))


def test_digest_is_that_of_spark(spark):
    words = ["a", "thé", "longer than thirty-two bytes of a word é" * 3]
    frame = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w"))
    assert {w: h & (2**64 - 1) for w, h in frame.collect()} == {w: digest(w.encode()) for w in words}


def test_ranked_against_all_pairs(spark, monkeypatch):
    rows = texts()
    items = queries(rows)
    want = brute(rows, items)
    got = dualtree.ranked(docs(spark, rows).repartition(3), asked(spark, items))
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == want
    # blocks of few items, small tiles
    monkeypatch.setattr(dualtree, "_ROWS", 16)
    small = dualtree.ranked(docs(spark, rows), asked(spark, items), block_terms=200, tile_entries=100)
    assert rows_of(small, "item_id", "rank", "doc_id", "score") == want


def test_many_copies_tie_by_id(spark):
    rows = [(i, "one and the same text") for i in range(300)] + [(400 + i, f"other words {i}") for i in range(100)]
    got = dualtree.ranked(docs(spark, rows[::-1]).repartition(4), asked(spark, [(1, "same text"), (2, "words")]), k=7)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute(rows, [(1, "same text"), (2, "words")], 7)


def test_empty_tables(spark):
    assert dualtree.ranked(empty(spark), asked(spark, [(1, "a")])).collect() == []
    assert dualtree.ranked(docs(spark), asked(spark, []).limit(0)).collect() == []


def test_node_bounds_hold_and_prune():
    """Bounds are never below a score under their nodes, and far nodes fall below a good k-th score."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(1)
    words = [f"w{k:03}" for k in range(200)]
    bags = [Counter(rng.choices(words[:100] if r % 2 else words[100:], k=30)) for r in range(600)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(600)), pa.array([30] * 600), pa.array([list(b) for b in bags]), pa.array([list(b.values()) for b in bags])], names=["id", "n", "terms", "tf"]
    )
    lists = [np.array(sorted(rng.sample(range(100 * (k % 2), 100 + 100 * (k % 2)), 12))) for k in range(24)]
    items = dualtree.Items(list(range(24)), np.arange(0, 300, 12), np.concatenate(lists), pa.array(words), np.full(200, 1000))
    tile = dualtree.Tile(batch, items, 600, 18000)
    pruned = 0
    for (a, b), terms in zip(items.groups, items.maxima, strict=True):
        for level, wide in ((0, 8 * 64), (1, 64), (2, 8)):
            nodes = np.arange(tile.levels[level].shape[1])
            bound = tile.bounds(level, terms, nodes)
            for i in range(a, b):
                row, score = tile.scores(items.lists[i], np.arange(tile.leaves))
                assert (bound[row // wide] >= score).all()
                own = tile.bounds(level, items.lists[i], nodes)
                assert (own <= bound).all() and (own[row // wide] >= score).all()
                pruned += int((own < np.sort(score)[-10]).sum())
    assert pruned > 100
