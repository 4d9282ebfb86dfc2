"""Alignment of two tokenizers against a plain walk over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from eraflow.llm import alignment

from .data import docs, empty, rows_of, texts

public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "ß", " ", " ", "  ", "\n", "\t", "'s", "12", "<|endoftext|>", "</s>", "中文", "▁", "😀", "\xa0", ".", "***", "\x1c", "　", "日本"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(400)]


def brute(rows):
    """Whole texts, tokens as byte strings, every pair of tokens with overlapping ranges."""
    encoder = alignment.Encoder(A, B)
    found = []
    for i, text in rows:
        want = b" " + (text or "").encode()
        a = encoder.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = encoder.b.encode(text) if text else []
        if not text or b"".join(encoder.a_bytes[x] for x in a) != want or b"".join(encoder.b_bytes[x] for x in b) != want:
            found.append((i, [], [], [], ""))
            continue
        ends = [np.cumsum([len(t[x]) for x in ids]).tolist() for t, ids in ((encoder.a_bytes, a), (encoder.b_bytes, b))]
        links, groups, low = [], [], (0, 0)
        x = y = 0
        while x < len(a) and y < len(b):
            links.append((a[x], b[y]))
            p, q = ends[0][x], ends[1][y]
            x, y = x + (p <= q), y + (q <= p)
            if p == q:
                groups.append(",".join(map(str, a[low[0] : x])) + "|" + ",".join(map(str, b[low[1] : y])))
                low = (x, y)
        found.append((i, a, b, links, ";".join(groups)))
    held = Counter(pair for *_, links, _ in found for pair in set(links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return sorted(
        (
            (i, len(a), len(b), g.count(";") + bool(g), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
            for i, a, b, links, g in found
        ),
        key=repr,
    )


def test_merge_path_against_sorting():
    rng = np.random.default_rng(3)
    for width in (1, 2, 7, 128):
        for _ in range(30):
            n = int(rng.integers(1, 300))
            a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n)), n)).astype(np.int64) for _ in range(2))
            i, j, common = alignment.merge_path(a, b, width)
            ends = np.union1d(a, b)
            assert np.array_equal(i, np.searchsorted(a, ends)) and np.array_equal(j, np.searchsorted(b, ends))
            assert np.array_equal(common, np.isin(ends, a) & np.isin(ends, b))
            diagonals = np.arange(0, len(a) + len(b), width)
            merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
            assert alignment.crossings(a, b, diagonals).tolist() == [sum(s == 0 for _, s in merged[:d]) for d in diagonals]


def test_safe_parts_join_back():
    for text in odd_texts() + [t for _, t in texts() if t]:
        assert " ".join(alignment.safe_parts(text)) == text
        assert " ".join(alignment.segments(text, 10)) == text


def test_aligned_against_brute_force(spark):
    rows = texts() + [(1000 + k, t) for k, t in enumerate(odd_texts())]
    assert rows_of(alignment.aligned(docs(spark, rows).repartition(5), A, B), *COLUMNS) == brute(rows)


def test_small_strips_and_slices_give_the_same(spark):
    rows = texts()
    got = alignment.aligned(docs(spark, rows), A, B, strip=64, slice_bytes=300)
    assert rows_of(got, *COLUMNS) == brute(rows)


def test_empty_table_and_forgotten_parts(spark, monkeypatch):
    assert alignment.aligned(empty(spark), A, B).collect() == []
    encoder = alignment.Encoder(A, B, most=1)
    first = encoder.places(["one", "two"])
    encoder.trim()
    assert encoder.places(["two"]).tolist() == [0] and len(first) == 2
