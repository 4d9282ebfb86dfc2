"""Personal data by the patterns as they stand, and revealing terms against counts by hand."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from eraflow.llm import disclosure

from .data import docs, empty, rows_of, texts

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number):
    total = 0
    for k, d in enumerate(map(int, reversed(number))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def plain(text):
    """The contract's patterns, word for word."""
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(n := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(n)]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def noise(n, seed=4):
    rng = random.Random(seed)
    bits = ["a", "Z.", "@", "@x", ".c", "..", "1", "23", "255", "256", ".", "-", " ", "+", "+4", "(0)", "é", "4871316720949013", "4871 3167-2094 9013", "00", "%", "_", "\n", "9.9.9.9"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def corpus():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, t) for i, t in texts()]
    for k in range(12):  # the handle always stands near the address, the number of its team only mostly
        say = rng.sample(words, 20)
        rows.append((100 + k, " ".join(say[:10]) + f" Handle7 team{k % 2} write to Jo.Doe@Mail.example.com or {k}.0.0.1 " + " ".join(say[10:]) + " handle7"))
    rows += [(200 + k, f"team0 {' '.join(rng.sample(words, 8))} handle{k}x") for k in range(8)]
    rows += [(300, "handle7 alone"), (301, rows[-30][1]), (302, None), (303, "")]
    rows += [(400 + k, f"{' '.join(rng.sample(words, 3))} zebra call +1 (499) 555-65{k % 3}3 now") for k in range(9)]
    return rows


def by_hand(rows, window=8, least=2**-0.5, support=3):
    """Spans of revealing terms per row from counts over the different texts."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    near, whole, mentions = defaultdict(set), defaultdict(set), {}
    for text in {t for _, t in rows if t}:
        spans = plain(text)
        words = [(disclosure.lowered(m.group()), *m.span()) for m in term.finditer(text)]
        for w, _, _ in words:
            whole[w].add(text)
            whole[disclosure.general(w)].add(text)
        mentions[text] = set()
        for k, b, e in spans:
            name = disclosure.entity(k, text[b:e])
            mentions[text].add(name)
            before = [m for m in term.finditer(text[:b])][-window:]
            after = [m for m in term.finditer(text, e)][:window]
            for m in before + after:
                if not any(m.start() < f and m.end() > a for _, a, f in spans):
                    low = disclosure.lowered(m.group())
                    near[name, low].add(text)
                    near[name, disclosure.general(low)].add(text)
    over = {p for p, held in near.items() if len(held) >= support and len(held) / len(whole[p[1]]) >= least}
    out = []
    for i, text in rows:
        spans = plain(text or "")
        own = []
        for m in term.finditer(text or ""):
            low = disclosure.lowered(m.group())
            tells = [c for c in mentions.get(text, ()) if (c, low) in over]
            if tells and not any(m.start() < f and m.end() > a for _, a, f in spans):
                own.append((m.start(), m.end(), low, "remove" if (tells[0], disclosure.general(low)) in over else "generalise"))
        out.append((i, *(sum(s[0] == k for s in spans) for k in range(4)), ",".join(f"{disclosure.KINDS[k]}:{b}:{e}" for k, b, e in spans), ",".join(f"term:{b}:{e}" for b, e, *_ in own), [x[2:] for x in own]))
    return sorted(out, key=repr)


def test_base_spans_are_those_of_the_patterns():
    for text in noise(6000) + ["a@b.c@d.e", "x@@y.z", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "300.1.1.1.1", "0000255.1.1.01", "+12 (34)-", "5" * 40]:
        assert disclosure.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 100_000, "1." * 200_000, "+1 " * 100_000, "1 " * 200_000, "@" * 300_000):
        disclosure.base_spans(text)


@pytest.mark.parametrize("parts", [1, 5])
def test_spans_against_counts_by_hand(spark, parts):
    rows = corpus()
    got = disclosure.private_spans(docs(spark, rows).repartition(parts)).collect()
    found = sorted(
        ((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_spans, r.term_spans, [(x.term, x.action) for x in r.terms or []]) for r in got), key=repr
    )
    want = by_hand(rows)
    assert found == want
    assert {x for r in want for x in r[7]} >= {("handle7", "remove"), ("zebra", "remove")} or any("handle7" in str(r) for r in want)
    assert all(not r[6] for r in want if not r[5])


def test_general_forms_are_used_where_they_tell_less(spark):
    rows = corpus() + [(500 + k, f"team handles{k} handl") for k in range(20)]
    got = {x.term: (x.action, x.general) for r in disclosure.private_spans(docs(spark, rows)).collect() for x in r.terms or []}
    assert got["handle7"] == ("generalise", "hand*")
    text = {r.doc_id: r.text for r in disclosure.sanitised(docs(spark, rows), support=3).collect()}
    assert "hand* team" in text[100] and "[EMAIL]" in text[100] and text[100].endswith("hand*")
    assert text[300] == "handle7 alone" and text[302] is None and text[303] == ""


def test_sanitised_keeps_rows_and_columns(spark):
    rows = corpus()
    frame = docs(spark, rows).withColumnRenamed("kept", "a`b c").withColumnRenamed("id", "row").withColumnRenamed("anchor", "others")
    out = disclosure.sanitised(frame)
    assert out.columns == frame.columns and out.count() == len(rows)
    assert rows_of(out, "doc_id", "row", "`a``b c`") == rows_of(frame, "doc_id", "row", "`a``b c`")


def test_query_digest(spark, tmp_path):
    from eraflow.llm import queries

    rows = corpus()
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_private_terms(spark, str(tmp_path)).collect() if r.doc_id is not None}
    for i, *_, base, terms, _ in by_hand([r for r in rows]):
        if i is not None and i != 55:
            assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert got[i].spans == ",".join(filter(None, (base, terms)))


def test_empty_table(spark):
    assert disclosure.private_spans(empty(spark)).collect() == []
    assert disclosure.sanitised(empty(spark)).collect() == []
