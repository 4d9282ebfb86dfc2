"""Repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from eraflow.llm import suffixes

from .data import docs, empty, texts


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def same(spark, rows, length=200):
    got = suffixes.without_repeats(docs(spark, rows), length=length).collect()
    have = Counter((r["doc_id"], r["n_removed"], len(r["spans"] or []), hashlib.sha256(r["kept"]).hexdigest()) for r in got)
    assert have == Counter((i, *b) for (i, _), b in zip(rows, brute(rows, length)))


def test_repeats_against_brute_force(spark):
    same(spark, texts())


def test_many_contexts_of_one_passage(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", 5)  # many merges of one anchor
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, tail = word(230), word(90)
    rows = [(i, word(rng.randrange(150, 300)) + passage + word(rng.randrange(0, 300))) for i in range(30)]
    rows += [(100 + i, word(200) + passage[:150] + tail) for i in range(12)] + [(200, passage + passage)]
    same(spark, rows)


def test_two_letters(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    parts = [word(70) for _ in range(4)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))) for i in range(25)]
    same(spark, rows)
    same(spark, rows, 64)


def test_merge_orders_suffixes_like_a_sort():
    rng = random.Random(6)
    shards = [np.frombuffer("".join(rng.choice("abc") for _ in range(n)).encode(), np.uint8) for n in (300, 1, 257, 90)]
    whole = b"".join(s.tobytes() for s in shards)
    position, block = suffixes.merged(shards, [suffixes.suffix_order(s, 48) for s in shards], 48)
    inner = [p for p in position if p + 48 <= len(whole)]
    assert [whole[p : p + 48] for p in inner] == sorted(whole[p : p + 48] for p in range(len(whole) - 47))
    of = dict(zip(position.tolist(), block.tolist()))
    assert all((of[a] == of[b]) == (whole[a : a + 48] == whole[b : b + 48]) for a, b in zip(inner, inner[1:]))
    order = suffixes.suffix_order(shards[0], 48)
    assert sorted(suffixes.transform(shards[0], order)) == sorted(shards[0])


def test_trimmed_keeps_columns_and_characters(spark):
    rows = texts()
    df = docs(spark, rows)
    out = suffixes.trimmed(df)
    assert out.columns == df.columns and out.count() == len(rows)
    texts_of = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    assert texts_of[51] is None and texts_of[50] == "" and texts_of[53] == "one" and texts_of[55] == ""
    assert len(texts_of[20]) < len(dict(rows)[20])


def test_no_rows(spark):
    assert suffixes.without_repeats(empty(spark)).count() == 0
    assert suffixes.trimmed(empty(spark)).count() == 0
