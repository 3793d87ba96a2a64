"""Main text of web pages by a minimum cut over their blocks.

A page is read once into blocks: runs of text between the borders of block elements, each with its open
elements. A logistic classifier over features of the text (length, share of linked text, sentence ends,
paragraph element) gives each block a log-odds for content; open elements that say what they are (article,
main; nav, footer, aside, form, names such as "sidebar" or "cookie") add evidence of fixed weight. Inside an
article or main element only names of what is never part of an article count (adverts, menus, sidebars, notices,
forms, comments, footers), so that a paragraph of class "more" or "tags" stays; names such as "related" or "share"
count outside only. body, html and elements that hold every article and main element of the page say nothing
against content, unless hidden. The costs become terminal capacities of a graph whose smoothness edges join
neighbouring blocks (stronger under one parent) and blocks next to each other within one container. The maximum
flow's cut leaves the content on the source's side.

The classifier is trained here, on at most SAMPLE pages, chosen by a hash of their address and source, whose blocks
inside and outside an article or main element serve as labels. Without such pages the evidence decides.

Text: character references decoded, white space inside a block one space, trimmed, blocks in page order
joined by two line feeds. Text in scripts, styles, templates, comments and the head is never a block.

Edge cases: null, empty and text-free pages give an empty text. Broken markup is read as far as it goes, in time
proportional to the page: elements not closed, stray tags; an unclosed comment or script runs to the end, and so
does a tag without its ">"; a quote that is not closed where an attribute can end does not hide the ">" after it.
Pages are read whole. Equal pages get equal texts, repeated rows each their own; other input columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

SAMPLE = 1500

_tag_name = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_to_quote = re.compile(r"[^>\"'=]*+(?:=\s*+)?+")
#: Elements left out with their text.
SKIPPED = {x: re.compile(rf"</{x}\s*+>", re.I) for x in "script style template noscript svg title iframe textarea select".split()}
_names = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_hidden = re.compile(r"""\bhidden\b(?!\s*-)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr"}

#: Evidence of open elements, as log-odds for content.
TAGS = {"nav": -9, "footer": -9, "aside": -9, "form": -9, "menu": -7, "button": -9, "dialog": -9, "header": -7, "label": -5, "article": 6, "main": 5}
#: Names of what no article holds as its own text.
NAMES = {
    **dict.fromkeys("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion".split(), -9),
    **dict.fromkeys("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager".split(), -9),
    **dict.fromkeys("sidebar aside footer masthead".split(), -9),
    **dict.fromkeys("cookie cookies consent gdpr notice notices popup modal overlay subscribe newsletter signup paywall".split(), -9),
    **dict.fromkeys("comment comments commentlist disqus respond".split(), -9),
    **dict.fromkeys("content article story post entry body main text".split(), 3),
}
#: Names that speak against content outside article and main elements only.
OUTSIDE = dict.fromkeys("alert side rail widget widgets related recommended recommendations more trending popular tags toc skip share sharing social foot copyright legal header login search toolbar byline discussion reply replies".split(), -9)
LEAST, MOST = -12.0, 12.0
NEIGHBOURS, SIBLINGS, CONTAINER = 0.6, 1.0, 0.4  # capacities of smoothness edges


class Block:
    __slots__ = ("text", "tag", "linked", "evidence", "parent", "container", "inside", "outside")

    def __init__(self, text, tag, linked, evidence, parent, container, inside, outside):
        self.text, self.tag, self.linked, self.evidence = text, tag, linked, evidence
        self.parent, self.container, self.inside, self.outside = parent, container, inside, outside


def _evidence(tag: str, attributes: str, open_article: bool, holder: bool = False) -> tuple[float, bool]:
    """Evidence of one element; and whether it says that it is no content. Of a holder of all articles only what speaks for content counts, and hiding."""
    got = TAGS.get(tag, 0)
    if holder:
        got = max(got, 0)
    if tag == "header" and open_article:
        got = 0  # an article's own header holds its title
    if attributes:
        words = set()
        for m in _names.finditer(attributes):
            words.update(x.lower() for x in _part.findall(m[1] or m[2] or m[3] or ""))
        if words:
            weights = [NAMES.get(w, 0 if open_article else OUTSIDE.get(w, 0)) for w in words]
            named = [w for w in weights if w and not (holder and w < 0)]
            if named:
                got += min(named) if min(named) < 0 else max(named)
        if _hidden.search(attributes):
            got -= 9
    return got, got < 0


class _Reader:
    """Pieces of a page in order: ("text", raw), ("open", tag, attributes), ("close", tag), ("skip",). Every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.none_after = {}  # what does not occur from a place on, to the end

    def _find(self, what: str, at: int) -> int:
        if at >= self.none_after.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none_after[what] = at
        return found

    def _tag_end(self, at: int) -> int:
        """The place of the ">" that ends a tag whose attributes begin at a place; -1: none."""
        page = self.page
        while True:
            i = _to_quote.match(page, at).end()
            if i >= len(page):
                return -1
            c = page[i]
            if c == ">":
                return i
            if c in "\"'" and page[at:i].rstrip()[-1:] == "=":
                end = self._find(c, i + 1)
                if end >= 0 and (end + 1 == len(page) or page[end + 1] in " \t\r\n\f/>"):
                    i = end
                else:  # not closed where an attribute can end
                    return self._find(">", i)
                at = i + 1
                continue
            at = i if c == "=" and i > at else i + 1

    def __iter__(self):
        page, at = self.page, 0
        while at < len(page):
            i = self._find("<", at)
            if i < 0:
                yield "text", page[at:]
                return
            if i > at:
                yield "text", page[at:i]
            c = page[i + 1 : i + 2]
            if c == "!" or c == "?" or c == "/" and not page[i + 2 : i + 3].isalpha():
                comment = page.startswith("<!--", i)
                end = self._find("-->" if comment else ">", i + 2)
                at = len(page) if end < 0 else end + (3 if comment else 1)
                continue
            m = _tag_name.match(page, i + 2 if c == "/" else i + 1)
            if not m:
                yield "text", "<"
                at = i + 1
                continue
            end = self._find(">", m.end()) if c == "/" else self._tag_end(m.end())
            if end < 0:
                return
            tag, at = m[0].lower(), end + 1
            if c == "/":
                yield "close", tag
            elif tag in SKIPPED:
                end = SKIPPED[tag].search(page, at)
                at = end.end() if end else len(page)
                yield ("skip",)
            else:
                yield "open", tag, page[m.end() : end]


class _Stack:
    """Open elements: tag, evidence with that of the elements around, number, article open, container, no content. Knows where each tag is open."""

    def __init__(self):
        self.items: list[tuple] = [("", 0.0, 0, False, 0, False)]
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.low = 0  # the least height since it was last set

    def push(self, item: tuple) -> None:
        self.where.setdefault(item[0], []).append(len(self.items))
        if item[0] in BLOCK:
            self.blocks.append(len(self.items))
        self.items.append(item)

    def cut(self, height: int) -> None:
        for tag, *_ in self.items[height:]:
            self.where[tag].pop()
        while self.blocks and self.blocks[-1] >= height:
            self.blocks.pop()
        del self.items[height:]
        self.low = min(self.low, height)

    def last(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def close(self, tags: tuple, within: tuple) -> None:
        """Close the innermost of tags, unless one of within is open inside it."""
        i = self.last(tags)
        if i > self.last(within):
            self.cut(i)

    def block(self) -> tuple:
        return self.items[self.blocks[-1] if self.blocks else 0]


AROUND_P = ("div", "section", "article", "main", "td", "th", "li", "blockquote", "aside", "footer", "header", "nav", "form")
LISTS = ("ul", "ol", "menu", "dl", "table", "select")


def blocks_of(page: str) -> list[Block]:
    blocks, holders = _blocks(page, frozenset())
    return _blocks(page, holders)[0] if holders else blocks


def _blocks(page: str, holders: frozenset) -> tuple[list[Block], frozenset]:
    """Blocks, and which elements (by number) hold every article and main element, if one of them speaks against content.

    holders: those elements, known from a first pass.
    """
    out: list[Block] = []
    stack = _Stack()
    chain, common = [], 0  # elements around the first article, and how many of them hold all articles so far
    against_all: set = set()
    number, buffer, linked = 0, [], 0

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                top, holder = stack.items[-1], stack.block()
                out.append(Block(text, holder[0], min(linked, len(text)) / len(text), top[1], holder[4], holder[2], top[3], top[5]))
            buffer.clear()
            linked = 0

    for piece in _Reader(page):
        kind = piece[0]
        if kind == "text":
            raw = piece[1]
            text = html.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if stack.where.get("a"):
                linked += len(text)
            continue
        if kind == "skip":
            buffer.append(" ")
            continue
        tag = piece[1]
        if tag in ("br", "td", "th"):
            buffer.append(" ")
        if kind == "close":
            if tag in BLOCK:
                flush()
            i = stack.last((tag,))
            if i and (tag in BLOCK or not stack.blocks or i > stack.blocks[-1]):  # an inline element does not close blocks
                stack.cut(i)
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                stack.close(("p",), AROUND_P)
            if tag in ("li", "dt", "dd", "option", "tr"):
                stack.close((tag,) if tag in ("li", "option", "tr") else ("dt", "dd"), LISTS)
        if tag in VOID:
            continue
        top = stack.items[-1]
        number += 1
        got, against = _evidence(tag, piece[2], top[3] or tag in ("article", "main"), tag in ("body", "html") or number in holders)
        if against:
            against_all.add(number)
        outside = top[5] or against
        stack.push((tag, min(top[1] + got, LEAST / 2) if outside else top[1] + got, number, (top[3] or tag in ("article", "main")), top[2], outside))
        if tag in ("article", "main"):
            if not chain:
                chain = [x[2] for x in stack.items]
                common = len(chain)
            else:
                common = min(common, stack.low)
            stack.low = len(stack.items)
    flush()
    around = frozenset(chain[:common])
    return out, around if around & against_all else frozenset()


def features(b: Block) -> list[float]:
    n = len(b.text)
    return [1.0, math.log1p(n), b.linked, float(b.text[-1] in ".!?\"'”…"), float(b.tag == "p"), float(b.tag[:1] == "h" and b.tag[1:].isdigit()), float(b.tag == "li"), sum(c in ",.;:" for c in b.text) / n]


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut; edges carry as much in both directions.

    Breadth-first levels and blocking flows over residual capacities. What a node's two terminals can
    exchange directly is taken off first, so that each node keeps one terminal.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    left: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def link(u, v, c, back):
        at[u].append(len(to))
        to.append(v)
        left.append(c)
        at[v].append(len(to))
        to.append(u)
        left.append(back)

    for i in range(n):
        direct = min(source[i], sink[i])
        if source[i] > direct:
            link(s, i, source[i] - direct, 0.0)
        elif sink[i] > direct:
            link(i, t, sink[i] - direct, 0.0)
    for u, v, c in edges:
        link(u, v, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in at[u]:
                if left[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        while True:
            path, u = [], s
            while u != t:
                while place[u] < len(at[u]):
                    e = at[u][place[u]]
                    if left[e] > tiny and level[to[e]] == level[u] + 1:
                        break
                    place[u] += 1
                else:
                    if not path:
                        break
                    level[u] = -1
                    u = to[path.pop() ^ 1]
                    place[u] += 1
                    continue
                path.append(e)
                u = to[e]
            if u != t:
                break
            flow = min(left[e] for e in path)
            for e in path:
                left[e] -= flow
                left[e ^ 1] += flow


def content(blocks: list[Block], weights) -> list[bool]:
    source, sink, edges, last = [], [], [], {}
    for i, b in enumerate(blocks):
        odds = max(LEAST, min(MOST, b.evidence + sum(w * x for w, x in zip(weights, features(b)))))
        source.append(max(odds, 0.0))
        sink.append(max(-odds, 0.0))
        if i:
            edges.append((i - 1, i, SIBLINGS if blocks[i - 1].parent == b.parent else NEIGHBOURS))
        before = last.get(b.parent)
        if before is not None and before != i - 1:
            edges.append((before, i, CONTAINER))
        last[b.parent] = i
    return min_cut(source, sink, edges)


#: Used when no page has an article or main element to learn from.
PLAIN = [-3.0, 0.9, -4.0, 0.8, 1.0, 0.0, -0.5, 0.0]
#: The text's own features move the odds by no more than this many units, so that stated roles prevail.
TEXT_WEIGHT = 0.5


def extract(page: str | None, weights=PLAIN) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, keep in zip(blocks, content(blocks, weights)) if keep)


def train(pages: list[str], rounds: int = 200) -> list[float]:
    """Logistic regression by Newton-free gradient steps on blocks inside and outside of article or main."""
    x, y = [], []
    for page in pages:
        blocks = blocks_of(page)
        if any(b.inside for b in blocks):
            x += [features(b) for b in blocks]
            y += [b.inside and not b.outside for b in blocks]
    y = np.array(y, float)
    if not len(y) or y.min() == y.max():
        return PLAIN
    x = np.array(x)
    scale = np.maximum(x.std(axis=0), 1e-3)
    scale[0] = 1
    z, w = x / scale, np.zeros(x.shape[1])
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        w -= 0.5 * (z.T @ ((p - y) * balance) / len(y) + 1e-2 * w)
    return [float(v) * TEXT_WEIGHT for v in w / scale]


def fit(pages: DataFrame, html_col: str = "html", url_col: str = "url", sample: int = SAMPLE) -> list[float]:
    rows = pages.where(pages[html_col].isNotNull()).select(F.xxhash64(pages[url_col], pages[html_col]).alias("h"), pages[html_col].alias("html"))
    return train([r["html"] for r in sorted(C.smallest(rows, "h", sample), key=lambda r: (r["h"], r["html"]))])


def text_of(pages: DataFrame, weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    C.prepare(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [extract(x, weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html")).mapInArrow(run, "page_id long, url string, text string")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    return text_of(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
