"""Toxicity, mixing, tokens, licenses and tiling."""

import math
import random
import re
from collections import Counter

import pytest

from eraflow.llm import licenses, mixing, queries, tiling, tokens, toxicity

from .data import docs, empty, sentence, texts


def patterns(text, **kinds):
    grammar = toxicity.Grammar()
    grammar.stems = kinds
    return dict(toxicity.Matcher(grammar).patterns(text))


def test_clause_patterns():
    assert patterns("You are an idiot.") == {"I+": 1}
    assert patterns("an idiot, you are") == {"I+": 1}
    assert patterns("What an idiot") == {"I": 1}
    assert patterns("You. idiot") == {"I": 1}  # another clause
    assert patterns("not an idiot") == {"i": 1}
    assert patterns("never in all my long life an idiot") == {"I": 1}  # out of reach
    assert patterns("He said idiot") == {"J+": 1}
    assert patterns("wrote: fine. I will kill you") == {"T+": 1}
    assert patterns("you they not said") == {}
    assert patterns("two idiots and a moron", idiots="W") == {"W": 1, "I": 1}


def test_composed_machine_equals_one_after_another():
    rng = random.Random(1)
    machines = [toxicity.negation(), toxicity.reporting(), toxicity.clauses()]
    whole = toxicity.compose(toxicity.compose(machines[0], machines[1]), machines[2])
    for _ in range(300):
        states, state = [0, 0, 0], 0
        for _ in range(20):
            symbol = first = rng.choice("OYRNEIWT")
            for k, m in enumerate(machines):
                states[k], symbol = m[states[k], symbol]
            state, emitted = whole[state, first]
            assert emitted == symbol


def test_long_text_counts_like_short_ones():
    part = "You are an idiot. Nothing here at all, only words.\n"
    n = 3 * toxicity._STRETCH // len(part)
    assert toxicity.Matcher(toxicity.Grammar()).patterns(part * n) == Counter({"I+": n})


def test_fit_and_score(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        words = sentence(rng, 40).split(" ")
        if bad:
            words[rng.randrange(40)] = rng.choice(["idiot", "grumblix", "grumblor", "scum"])
        rows.append((1000 + i, " ".join(words)))
        labels.append((1000 + i, int(bad)))
    labels += [(1000, 0), (None, 1), (9999, 1), (1003, None)]
    label = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    df = docs(spark, rows + texts()[20:])
    grammar = toxicity.fit(df, label.where(~toxicity.is_held_out()))
    assert any("grumbl".startswith(s[:6]) for s in grammar.stems)
    got = toxicity.score(df, grammar).collect()
    by = {r["doc_id"]: r for r in got}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert [by[i]["predicted"] for i, _ in rows] == [b for _, b in labels[:400]]
    assert by[50]["score"] == by[51]["score"] < 0.3
    kept = toxicity.clean(df, grammar)
    assert kept.columns == df.columns and kept.count() == len(got) - sum(r["predicted"] for r in got)
    bare = toxicity.fit(df, label.limit(0))
    assert bare.words == toxicity.Grammar().words
    assert toxicity.score(empty(spark), bare).count() == 0


def test_rare_words_are_learnt_from_many_features(spark):
    rng = random.Random(12)
    filler = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)) for _ in range(7000))
    rows = [(i, filler + (" zorgblat" if i else "")) for i in range(6)] + [(i, filler if i < 12 else sentence(rng, 30)) for i in range(6, 56)]
    label = spark.createDataFrame([(i, int(i < 6)) for i, _ in rows], "doc_id bigint, toxic int")
    counts = Counter(f for i, t in rows[:6] for f in toxicity._features(t))
    assert sum(n > 5 for n in counts.values()) > 50_000
    grammar = toxicity.fit(docs(spark, rows), label)
    assert any("zorgblat".startswith(s) for s in [*grammar.stems, *grammar.words])


def poisson(rate, u):
    k, term = 0, math.exp(-rate)
    total = term
    while total <= u and k < 10_000:
        k += 1
        term *= rate / k
        total += term
    return k


def test_poisson_count_inverts_the_distribution(spark):
    rng = random.Random(4)
    pairs = [(r, rng.random()) for r in (0.0, 0.1, 1.0, 7.5, 80.0, 499.0) for _ in range(40)] + [(3.0, 0.0), (3.0, 1 - 2**-52)]
    got = spark.createDataFrame(pairs, "r double, u double").select("r", "u", mixing.poisson_count(*map(__import__("pyspark.sql.functions").sql.functions.col, "ru")).alias("k")).collect()
    assert all(r["k"] == poisson(r["r"], r["u"]) for r in got)


def test_mixture(spark):
    rows = [(i, f"text {i}") for i in range(3000)]
    df = docs(spark, rows)
    out = mixing.mixture(df, targets={"src0": 3.0, "src1": 1.0}, total=4000).collect()
    share = Counter(r["source"] for r in out)
    assert set(share) == {"src0", "src1"}
    assert abs(share["src0"] - 3000) < 250 and abs(share["src1"] - 1000) < 150
    again = mixing.mixture(df.repartition(7), targets={"src0": 3.0, "src1": 1.0}, total=4000).collect()
    assert [(r["doc_id"], r["copy"]) for r in out] == [(r["doc_id"], r["copy"]) for r in again]
    copies = Counter(r["doc_id"] for r in out)
    assert all(r["n_copies"] == copies[r["doc_id"]] for r in out)
    keys = [r["shuffle_key"] for r in out]
    assert keys == sorted(keys)
    high = mixing.mixture(docs(spark, rows[:6]), targets={"src1": 1.0}, total=4000).count()
    assert abs(high - 4000) < 400  # rates above the split
    assert mixing.mixture(empty(spark)).count() == 0
    full = mixing.mixture(docs(spark), power=0.5)
    assert {"lang", "source", "copy", "n_copies", "shuffle_key"} <= set(full.columns) and full.count() > 0


def test_token_counts(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    rows = texts() + [(1000 + i, "".join(rng.choice("ab  \n\t▁é.\r") for _ in range(rng.randrange(30)))) for i in range(300)] + [(2000, "<s> </s> a  b "), (2001, "y" * 20000)]
    got = tokens.token_counts(docs(spark, rows), path, limit=100, batch_bytes=2000, remembered=50).collect()
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for i, t in rows)
    assert Counter(tuple(r) for r in got) == want
    assert tokens.token_counts(empty(spark), path).count() == 0


def test_licenses(spark):
    rng = random.Random(2)
    notice = licenses.NOTICES["Apache-2.0"][1]
    words = notice.split(" ")
    words[10] = "changed"
    rows = [(1, sentence(rng, 50) + "\n" + notice + "\n" + sentence(rng, 50)), (2, " ".join(words)), (3, " ".join(words[:12])), (4, None), (5, ""), (None, "Released under the MIT License."),
            (6, sentence(rng, 200_000) + " released UNDER the mit license " + sentence(rng, 100)), (7, sentence(rng, 300)), (7, sentence(rng, 300))]
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_notices(docs(spark, rows)).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["Apache-2.0"], 3: ["Apache-2.0"], 4: [], 5: [], None: ["MIT"], 6: ["MIT"], 7: []}
    assert licenses.license_notices(empty(spark)).count() == 0


def license_sets(text):
    words = re.findall(r"[a-z0-9\u0080-\uffff]+", text.lower())
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)}


def strongest_in(notice):
    """Names with the largest share of a template in this one notice, by brute force."""
    held = license_sets(notice)
    shares = [(len(license_sets(t) & held) / len(license_sets(t)), name) for name, ts in licenses.NOTICES.items() for t in ts]
    return {name for share, name in shares if share >= 0.8 and share == max(shares)[0]}


def test_neighbouring_licenses_against_brute_force(spark):
    rng = random.Random(4)
    pick = [(n, licenses.NOTICES[n][-1]) for n in ("Apache-2.0", "MIT", "BSD", "ISC", "MPL-2.0", "Unlicense", "CC-BY-SA-4.0", "LGPL-3.0", "AGPL-3.0", "GPL-2.0")]
    rows, want = [], {}

    def add(notices, gaps):
        want[len(rows)] = sorted(set().union(*map(strongest_in, notices)))
        rows.append((len(rows), sentence(rng, 9) + "".join(" " + n + " " + sentence(rng, g) for n, g in zip(notices, gaps))))

    def edited(notice, changes):
        words = notice.split(" ")
        for k in rng.sample(range(len(words)), changes):
            words[k] = f"changed{k}"
        return " ".join(words)

    for gap in (0, 1, 5, 20, 60, 100):
        for name in ("MIT", "BSD"):
            weak = licenses.NOTICES[name][-1].split(" ")
            weak[9] = "changed"
            strong = licenses.NOTICES["Apache-2.0"][1]
            for both in ([strong, " ".join(weak)], [" ".join(weak), strong]):
                add(both, [gap, 30])
                assert want[len(rows) - 1] == sorted(["Apache-2.0", name])
    for _ in range(300):
        chosen = rng.sample(pick[:7], rng.randrange(1, 4)) + rng.sample(pick[7:], rng.randrange(0, 2))
        rng.shuffle(chosen)
        notices = [edited(t, rng.randrange(0, 3)) for _, t in chosen]
        add([n for n in notices if strongest_in(n)], [rng.randrange(0, 90) for _ in notices])
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_notices(docs(spark, rows)).collect()}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def shared(a, b, seed):
    return [(i, j) for i in range(len(a) - seed + 1) for j in range(len(b) - seed + 1) if a[i : i + seed] == b[j : j + seed]]


def brute_tiles(a, b, seed):
    """Greedy string tiling, word by word."""
    ua, ub, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = None
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ua[i + n] and not ub[j + n]:
                    n += 1
                if n >= seed and (best is None or (-n, j, i) < best):
                    best = (-n, j, i)
        if best is None:
            return total
        n, j, i = -best[0], best[1], best[2]
        total += n
        for k in range(n):
            ua[i + k] = ub[j + k] = True


def test_tiles_against_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        a, b = [rng.choice("xyz") for _ in range(rng.randrange(40))], [rng.choice("xyz") for _ in range(rng.randrange(25))]
        laid = tiling.tiles(tiling.matches(shared(a, b, 3), 3), 3)
        assert sum(t[0] for t in laid) == brute_tiles(a, b, 3)


def test_contamination(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, 40)) for i in range(6)] + [(6, "too short"), (7, None), (8, ""), (None, sentence(rng, 30)), (0, sentence(rng, 40))]
    body = items[2][1].split(" ")
    moved = " ".join(body[20:] + sentence(rng, 7).split(" ") + body[:20])
    rows = [(1, sentence(rng, 50)), (2, sentence(rng, 30) + " " + items[1][1] + " " + sentence(rng, 5)), (3, "".join(c.upper() if c.isascii() else c for c in moved)), (4, " ".join(body[:15])), (5, None), (6, ""), (None, items[3][1]),
            (7, items[10][1]), (8, items[4][1]), (8, "clean " + sentence(rng, 20)), (9, "too short")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = docs(spark, rows)
    hit = {r["id"]: (r["item_ids"], round(r["coverage"], 3)) for r in tiling.contaminated(df, bench).collect()}
    assert hit == {2: ([1], 1.0), 3: ([2], 1.0), None: ([3], 1.0), 7: ([0], 1.0), 8: ([4], 1.0)}
    kept = tiling.without_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 4, 5, 6, 8, 9]
    assert tiling.contaminated(df, bench.limit(0)).count() == 0
    assert tiling.without_contaminated(empty(spark), bench).count() == 0


def test_contamination_query_with_null_ids(spark, tmp_path):
    rng = random.Random(6)
    item = sentence(rng, 40)
    docs(spark, [(None, item), (None, sentence(rng, 30)), (1, item), (2, sentence(rng, 30))]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in queries.op10_benchmark_decontamination(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([(None, True, 1.0, [9]), (None, False, 0.0, []), (1, True, 1.0, [9]), (2, False, 0.0, [])], key=repr)
