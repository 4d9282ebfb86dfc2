"""Near-duplicate operators and components against brute force."""

import random
import re

import numpy as np

from eraflow.llm import components, embeddings, minhash
from eraflow.llm.components import connected

from .data import docs, empty, groups, rows_of, sentence, texts


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(40, 70)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (8, 9)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    got = {r["id"]: r["component"] for r in connected(spark.createDataFrame(pairs + [(None, 3)], "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in pairs if a != b]
    want = groups(real, {x for p in real for x in p})
    assert got == want
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_end_at_stars(spark):
    frame = lambda pairs: spark.createDataFrame(pairs, "a bigint, b bigint")
    assert not components._unfinished(frame([(5, 1), (6, 1), (9, 2)])) and not components._unfinished(frame([]))
    assert components._unfinished(frame([(5, 1), (5, 2)])) and components._unfinished(frame([(5, 3), (3, 1)]))


def test_components_of_long_paths(spark):
    """Ids against the order of the path, so that every step moves the least id on."""
    ids = random.Random(2).sample(range(10**6), 300)
    got = {r["id"]: r["component"] for r in connected(spark.createDataFrame(list(zip(ids, ids[1:])), "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(ids, min(ids))


def shingle_sets(rows, size):
    out = {}
    for i, t in rows:
        words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        out[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    return out


def near_pairs(sets, percent):
    keys = sorted(k for k in sets if sets[k])
    return [
        (a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]


def test_minhash_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [r for r in texts() if r[0] is not None]
    base = sentence(rng, 200).split(" ")
    for i in range(60):  # chains of copies around the threshold
        base = list(base)
        for _ in range(rng.randrange(0, 9)):
            base[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(base)))
    for size in (4, 5):
        sets = shingle_sets(rows, size)
        want = groups(near_pairs(sets, 80), sets)
        got = minhash.near_duplicates(docs(spark, rows), size=size).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_minhash_short_texts(spark):
    rng = random.Random(8)
    rows, pairs = [], []
    for n, longer, edits, many in ((7, 1, 0, 3000), (11, 2, 0, 2000), (12, 0, 1, 1000), (19, 4, 0, 300), (21, 0, 2, 300)):
        for _ in range(many):
            a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            b = a[: n - edits] + [f"w{rng.randrange(10**9)}" for _ in range(longer + edits)]
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    sets = shingle_sets(rows, 4)
    assert all(100 * len(sets[a] & sets[b]) == 80 * len(sets[a] | sets[b]) for a, b in pairs)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), size=4).collect()}
    assert got == groups(pairs, sets)


def test_minhash_copies_of_one_text(spark):
    """Copies at a similarity of 0.6 to 0.9 to each other, with and without the text they were made from; words of the changes recur."""
    rng = random.Random(11)
    rows = []
    for group in range(2):
        base = sentence(rng, 150).split(" ")
        if group:
            rows.append((9000, " ".join(base)))
        for _ in range(150):
            words = list(base)
            for place in rng.sample(range(150), rng.randrange(2, 9)):
                words[place] = f"w{rng.randrange(40)}"
            rows.append((1000 * group + len(rows), " ".join(words)))
    sets = shingle_sets(rows, 4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), size=4).collect()}
    assert got == groups(near_pairs(sets, 80), sets)


def test_overlap_bound_loses_no_link(spark):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        base = [f"b{k}" for k in range(rng.choice((12, 60, 61)))]
        for place in rng.sample(range(len(base)), rng.randrange(0, 6)):
            base[place] = f"w{rng.randrange(30)}"
        rows.append((i, " ".join(base)))
    size = 3
    sets = shingle_sets(rows, size)
    texts = docs(spark, rows).selectExpr("doc_id as id", "text")
    every = texts.selectExpr("id as a", "id as b")
    full = minhash._sets_of(every, texts, size)
    rare = full.mapInArrow(minhash._rarest(minhash._levels(full), 80), minhash._SHOWN)
    n = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "a bigint, n bigint")
    x = rare.join(n, "a")
    y = x.selectExpr("a as b", "n as other_n", *[f"{c} as other_{c}" for c in minhash._MARKS])
    passed = {(r["a"], r["b"]) for r in x.join(y, x.a < y.b).where(minhash._overlap(80)).select("a", "b").collect()}
    assert set(near_pairs(sets, 80)) <= passed and len(passed) < 120 * 119 // 4


def test_releasing_keeps_what_it_is_told(spark):
    from eraflow.llm.common import releasing, stored

    with releasing(spark) as outer:
        with releasing(spark) as keep:
            gone, inner = stored(spark.range(3), "gone"), keep(stored(spark.range(4), "inner"))
        assert inner.count() == 4
        last = outer(stored(inner, "last"))
    assert last.count() == 4
    jvm = spark._jvm.org.apache.hadoop.fs
    for df, there in ((gone, False), (inner, False), (last, True)):
        path = jvm.Path(df.stored_at)
        assert path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) is there


def test_minhash_edges(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    nothing = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark)).collect()}
    assert nothing[50] == nothing[51][:0] + (0, 50, True) and nothing[51] == (0, 51, True) and nothing[52] == (0, 52, True)
    assert nothing[None][1] is None and nothing[None][2]
    one = minhash.one_of_each(docs(spark))
    assert one.columns == docs(spark).columns
    ids = [r["doc_id"] for r in one.collect()]
    assert ids.count(55) == 1 and ids.count(None) == 2 and 30 in ids and not {31, 40, 42} & set(ids)


def unit_pairs(vectors, threshold):
    usable = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.setdefault(i, []).append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)))
    keys = sorted(usable)
    return [
        (a, b) for n, a in enumerate(keys) for b in keys[n + 1 :]
        if any(len(x) == len(y) and float(x @ y) >= threshold for x in usable[a] for y in usable[b])
    ]


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    for i in range(120):
        rows.append((200 + i, (np.array(rows[i % 30][1]) + rng.normal(size=16) * rng.uniform(0.05, 0.4)).tolist()))
    rows += [(400 + i, rows[0][1]) for i in range(20)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] + [1.0] * 15), (505, [float("inf")] + [1.0] * 15), (506, [1.0, 2.0]), (507, [2.0, 4.0])]
    rows += [(0, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, label int")
    pairs = unit_pairs([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 0.95)
    ids = {i for i, _ in rows if i is not None}
    want = groups(pairs, ids)
    links = {i: sum(i in p for p in pairs) for i in ids}
    for tile in (64, 2048):
        got = embeddings.near_duplicates(df, tile=tile).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["vec_id"] is None:
                assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
            else:
                assert (r["n_links"], r["component_id"], r["kept"]) == (links[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(200, 40)) ** 3, rng.normal(size=(200, 40))
    ua, qa, sa, ea = embeddings.quantise(a)
    ub, qb, sb, eb = embeddings.quantise(b)
    rough = (qa.astype(float) @ qb.T.astype(float)) * sa[:, None] * sb
    assert (np.abs(ua @ ub.T - rough) <= ea[:, None] * (1 + eb) + eb).all()


def test_rows_are_kept_as_they_are(spark):
    assert rows_of(minhash.near_duplicates(docs(spark)), "doc_id") == rows_of(docs(spark), "doc_id")
