"""Main text of web pages by minimum-cut labelling of blocks.

A page becomes blocks of text with their path of open elements. A linear classifier
gives each block two costs, being taken for content or for boilerplate; they are the
capacities of its edges to the terminals. Neighbouring blocks are joined by smoothness
edges, stronger the more of their path they share, and blocks of one container are
joined to the container's previous block. The minimum cut of that graph, found by
augmenting paths, labels the blocks.

Before paths are searched, a block whose terminal edge outweighs all its smoothness
edges gets its label at once, which passes those edges on to its neighbours; that leaves
the cut the same and only small undecided parts to the search.

Null pages count as empty, and pages without text give an empty text. Character
references are decoded, white space inside a block becomes one space, and the kept
blocks are joined by one space in page order. Each row is handled alone, so repeated
rows and ids make no difference; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, pieces, quoted

by_value(__name__)

_PIECE = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|aria-label|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|\d+")

#: elements that don't break a block; fixed values of HTML
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del".split()
)
#: elements without an end tag; fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: an open element of the left kind ends at a start tag of the right kinds; fixed values of HTML
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
#: log odds for content of an element in the path, and of words in its class, id or role; weights of the classifier
ELEMENT = {
    "article": 3.0, "main": 2.0, "nav": -9.0, "footer": -9.0, "header": -4.0, "aside": -9.0, "form": -7.0, "button": -7.0, "menu": -7.0, "dialog": -7.0, "fieldset": -5.0,
    "figure": 0.5, "blockquote": 0.5, "head": -30.0,
}
WORDS = dict.fromkeys("article content main post entry story body prose text".split(), 1.0) | dict.fromkeys(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs"
    " sidebar side aside footer foot header masthead topbar cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login"
    " comment comments disqus respond reply replies share sharing social related recommended recommend widget toolbar pager pagination tags skip copyright legal disclaimer"
    " complementary contentinfo search form alert hidden".split(),
    -8.0,
)
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_SHARED = 0.5  # smoothness per shared path step
_SIBLING = 0.4


class Block:
    __slots__ = ("parts", "path", "linked", "size")

    def __init__(self, path):
        self.parts, self.path, self.linked, self.size = [], path, 0, 0


def _attributes(tag: str, attrs: str) -> float:
    """Log odds of an element."""
    score = ELEMENT.get(tag, 0.0)
    worst = best = 0.0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            worst = -30.0
        elif name in ("class", "id", "role", "aria-label", "itemprop"):
            for w in _WORD.findall(value):
                weight = WORDS.get(w, 0.0)
                worst, best = min(worst, weight), max(best, weight)
    return score + (worst or best)


def blocks(page: str) -> list[Block]:
    """Blocks of text with their path: (element number, tag, log odds of the path up to there)."""
    out: list[Block] = []
    stack: list[tuple[int, str, float]] = []
    link = 0
    number = 0
    now: Block | None = None
    for m in _PIECE.finditer(page):
        text = m["text"]
        if text is not None:
            if now is None:
                if text.isspace():
                    continue
                now = Block(tuple(stack))
                out.append(now)
            now.parts.append(text)
            size = len(text)
            now.size += size
            if link:
                now.linked += size
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "a":
                link = max(0, link - 1)
            if tag not in INLINE:
                now = None
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][1] == tag:
                        del stack[k:]
                        break
            continue
        if tag in INLINE:
            if tag == "a":
                link += 1
            attrs = m["attrs"]
            if tag in ("span", "small", "label") and attrs and _attributes(tag, attrs) < -4:
                now = None  # an inline element that is set apart by its class makes a block of its own
            continue
        now = None
        if tag in VOID:
            continue
        ends = stack and ENDED_BY.get(stack[-1][1])
        if ends and tag in ends:
            stack.pop()
        number += 1
        attrs = m["attrs"]
        own = _attributes(tag, attrs) if attrs and not attrs.isspace() else ELEMENT.get(tag, 0.0)
        stack.append((number, tag, (stack[-1][2] if stack else 0.0) + own))
    return out


def odds(block: Block, text: str) -> float:
    """Log odds that a block is content."""
    score = 0.5 + (block.path[-1][2] if block.path else 0.0)
    tag = block.path[-1][1] if block.path else ""
    density = block.linked / max(1, block.size)
    score -= 5.0 * density
    n = len(text)
    score += 1.5 if n > 200 else 0.8 if n > 80 else 0.2 if n > 25 else -0.3
    if tag in _HEADINGS:
        score += 0.5
    elif tag == "p":
        score += 1.0
    elif tag == "li":
        score -= 0.3
    if text[:1] in "©" or "all rights reserved" in text[-200:].lower():
        score -= 1.5
    return score


def smooth_edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours and to the last block of the same container."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1].path
            shared = 0
            for x, y in zip(a, b.path):
                if x[0] != y[0]:
                    break
                shared += 1
            edges.append((i - 1, i, _SHARED * shared / max(1, len(a), len(b.path)) + 0.05))
        if len(b.path) > 1:
            home = b.path[-2][0]
            if home in last and last[home] != i - 1:
                edges.append((last[home], i, _SIBLING))
            last[home] = i
    return edges


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source; ``terminal`` is the capacity from the source, or minus
    that to the sink. Ties go to the sink."""
    n = len(terminal)
    rest = list(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    load = [sum(x.values()) for x in near]
    sure = deque(i for i in range(n) if abs(rest[i]) > load[i])
    while sure:  # a terminal edge above all others decides
        i = sure.popleft()
        if label[i] is not None:
            continue
        label[i] = rest[i] > 0
        for j, c in near[i].items():
            if label[j] is None:
                del near[j][i]
                load[j] -= c
                rest[j] += c if label[i] else -c
                if abs(rest[j]) > load[j] + 1e-12:
                    sure.append(j)
    open_ = [i for i in range(n) if label[i] is None]
    for s in open_:
        while rest[s] > 1e-12:
            came, queue, end = {s: s}, deque([s]), -1
            while queue:
                x = queue.popleft()
                if rest[x] < -1e-12:
                    end = x
                    break
                for y, c in near[x].items():
                    if c > 1e-12 and y not in came and label[y] is None:
                        came[y] = x
                        queue.append(y)
            if end < 0:
                break
            flow, x = min(rest[s], -rest[end]), end
            while x != s:
                flow, x = min(flow, near[came[x]][x]), came[x]
            rest[s] -= flow
            rest[end] += flow
            x = end
            while x != s:
                y = came[x]
                near[y][x] -= flow
                near[x][y] = near[x].get(y, 0.0) + flow
                x = y
    reach = deque(i for i in open_ if rest[i] > 1e-12)
    within = set(open_)
    for i in open_:
        label[i] = rest[i] > 1e-12
    while reach:
        x = reach.popleft()
        for y, c in near[x].items():
            if c > 1e-12 and y in within and not label[y]:
                label[y] = True
                reach.append(y)
    return [bool(x) for x in label]


def main_text(page: str) -> str:
    if not page:
        return ""
    kept = []
    for b in blocks(page):
        raw = "".join(b.parts)
        text = " ".join((unescape(raw) if "&" in raw else raw).split())
        if text:
            kept.append((b, text))
    if not kept:
        return ""
    found = [b for b, _ in kept]
    labels = minimum_cut([odds(b, t) for b, t in kept], smooth_edges(found))
    return " ".join(t for (_, t), keep in zip(kept, labels) if keep)


def _extract(batches):
    for batch in pieces(batches, "html"):
        texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
        yield batch.drop_columns(["html"]).append_column("text", pa.array(texts, pa.string()))


def main_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the columns of ``keep``, text (main text, empty if none), n_chars (code points) per row."""
    rows = pages.select(*map(quoted, (id_col, *keep)), quoted(html_col).alias("html"))
    kinds = [f for f in rows.schema.fields if f.name != "html"]
    return rows.mapInArrow(_extract, T.StructType([*kinds, T.StructField("text", T.StringType())])).withColumn("n_chars", F.length("text").cast("bigint"))
