"""Archives and main text of pages."""

import base64
import hashlib
import io
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eraflow.llm import archives, extract


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://a.example/{i}", h, "x", 1) for i, h in rows], "page_id bigint, url string, html string, record_type string, offset int")


def test_round_trip_of_packages(spark):
    rng = random.Random(1)
    body = lambda: "<p>" + "".join(rng.choice("abcé \r\n\x00") for _ in range(rng.randrange(3000))) + "</p>"
    rows = [(i, body()) for i in range(40)] + [(100 + i, "<p>same</p>") for i in range(20)] + [(200, ""), (201, None), (202, ""), (5, "<p>same</p>"), (300, "HTTP/1.1 200 OK\r\n\r\nx\r\n\r\nWARC/1.1")]
    packages = archives.write_packages(pages(spark, rows + [(None, "<p>no id</p>")]), package_bytes=20_000)
    got = archives.read_packages(packages).collect()
    last = {}
    for i, h in rows:
        last[h or ""] = max(i, last.get(h or "", i))
    want = Counter()
    for i, h in rows:
        raw = (h or "").encode()
        first = last[h or ""]
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want[i, len(raw), sha, "response" if first == i else "revisit", None if first == i else first, raw if first == i else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == want
    assert packages.count() > 3 and packages.agg({"records": "sum"}).first()[0] == len(rows)
    with zipfile.ZipFile(packages.first()["path"].removeprefix("file:")) as z:  # another reader agrees
        assert z.testzip() is None and set(z.namelist()) == {archives.DATA, archives.INDEX}
        assert all(x.compress_type == zipfile.ZIP_STORED for x in z.infolist())
    none = archives.write_packages(pages(spark, []))
    assert archives.read_packages(none).count() == 0


def test_least_bytes_keeps_small_payloads(spark):
    packages = archives.write_packages(pages(spark, [(1, "ab"), (2, "ab"), (3, "abcdef"), (4, "abcdef")]), least_bytes=5)
    assert {r["page_id"]: r["record_type"] for r in archives.read_packages(packages).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


@pytest.mark.parametrize("name", [archives.DATA, archives.PLAIN])
def test_directory_and_walk(name):
    raw = [archives.record(i, "u", "response", b"x" * (i * 5000), archives.digest(b"x" * (i * 5000)), None) for i in range(4)]
    put = [archives.squeezed(r) for r in raw] if name == archives.DATA else raw
    file = io.BytesIO()
    pack = archives.Packer(file)
    pack.begin(name)
    for r in put:
        pack.write(r)
    pack.end()
    pack.close()
    method, start, size = archives.directory(file, len(file.getvalue()))[name]
    spots = list((archives.walk_members if name == archives.DATA else archives.walk)(file, start, size))
    assert method == 0 and [n for _, n in spots] == [len(r) for r in put]
    assert [archives.parse(archives._at(file, start + o, n))["bytes"] for o, n in spots] == [0, 5000, 10000, 15000]
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a.txt", b"hello")
        z.writestr("b.txt", b"hello" * 99, zipfile.ZIP_DEFLATED)
    found = archives.directory(plain, len(plain.getvalue()))
    assert found["b.txt"][0] == 8 and archives._at(plain, *found["a.txt"][1:]) == b"hello"
    with pytest.raises(ValueError):
        archives.directory(io.BytesIO(b"no archive"), 10)
    with pytest.raises(ValueError):
        archives.parse(raw[1].replace(b"xxxx", b"xyxx", 1))


def cost(label, terminal, edges):
    cut = sum(max(0, -t) if keep else max(0, t) for keep, t in zip(label, terminal))
    return cut + sum(c for a, b, c in edges if label[a] != label[b])


def test_minimum_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(500):
        n = rng.randrange(1, 8)
        terminal = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randrange(14))]
        best = min(cost([m >> i & 1 for i in range(n)], terminal, edges) for m in range(1 << n))
        assert cost(extract.minimum_cut(terminal, edges), terminal, edges) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><div class="menu"><a href="/">Home</a> <a href="/x">More</a></div></header><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; shoulders</h1><p>First <b>bo</b>ld   text with a <a href="/l">link</a> in it,
and some more words to read.<br>Next line.<p>Second paragraph &lt;tag&gt; &eacute;.</article>
<aside class="sidebar"><p>Some other long text that is not part of the article at all, but reads like one and has a full stop.</p></aside>
<!-- <p>hidden</p> --><div id="comments"><p>I liked this article very much, thank you for it, dear author of the text.</p></div>
<form><p>Your name</p><button>Send</button></form><div class="ad">Buy now.</div><footer>&copy; 2000 us</footer></body></html>"""


def test_main_text():
    assert extract.main_text(PAGE) == "Head & shoulders First bold text with a link in it, and some more words to read. Next line. Second paragraph <tag> é."
    assert extract.main_text("") == "" and extract.main_text("<nav>x</nav>") == ""
    assert extract.main_text("plain words, 1 < 2, and a few more of them to make a sentence of it.") == "plain words, 1 < 2, and a few more of them to make a sentence of it."
    assert extract.main_text("<article><p>open<script>never closed") == "open"
    big = "<article>" + "<p>word word word word word word</p>" * 20_000 + "</article>"
    assert len(extract.main_text(big).split()) == 120_000


def test_main_texts(spark):
    rows = [(1, PAGE), (1, PAGE), (2, None), (3, ""), (None, "<p>A sentence that is long enough to be the main text of a page, surely.</p>")]
    out = extract.main_texts(pages(spark, rows).withColumn("text", F.lit("x")))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = Counter((r["page_id"], r["n_chars"]) for r in out.collect())
    assert got == Counter({(1, len(extract.main_text(PAGE))): 2, (2, 0): 1, (3, 0): 1, (None, 69): 1})
    assert extract.main_texts(pages(spark, [])).count() == 0
