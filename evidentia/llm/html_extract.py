"""HTML main-text extraction by minimum-cut labelling.

A page is read into text blocks: the text between block-level tags, with what its open elements say. A classifier gives each
block a cost of calling it content and a cost of calling it boilerplate: the negative log probabilities of a logistic model over its own text
(length, share of link text, end marks, element) plus the signs of its elements (tag names, class and id words), both bounded.
The model is fitted on a bounded sample of the pages, on the blocks whose elements speak plainly for one label, and is what judges the others.
The costs are terminal capacities of a graph; edges between neighbours and between blocks of one parent element carry smoothness
capacities that fall with DOM distance, large enough to overrule a doubtful block. The minimum cut, found by max-flow, separates content from boilerplate.

Each page is one small graph of its own (blocks of one parent that follow each other and look alike are one node),
so the work is a map over the table: no shuffle, nothing shared but the model's few weights.

Cases: null, empty and text-free pages give an empty text; broken, unclosed and truncated markup is read as far as it goes; a page without any
block that looks like content gives an empty text; very long pages are read whole, in time about linear in their blocks; repeated rows give
their text each; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed lists of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "option")
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: Elements that a new one of the named kind closes.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Block-level openings end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("article aside body div footer form header main nav section table td th ul ol dl html".split())

_RAW_OPEN = re.compile(r"<(script|style|noscript|template|textarea|title|svg|iframe|object|select)\b", re.I)
_RAW_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+|\d+")

#: Fixed words of class, id and role attributes, and element names, that speak for boilerplate or content.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs footer header "
    "masthead sidebar aside widget cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login form search share social "
    "comment comments commentlist disqus reply replies respond discussion related recommended recommendations trending popular tags pagination pager toolbar copyright legal "
    "contentinfo complementary alert toast paywall outbrain taboola skip".split()
)
GOOD_WORDS = frozenset("article articlebody body content entry main maincontent post story text hentry blog".split())
BAD_TAGS = frozenset("nav footer aside form header menu dialog button label legend fieldset".split())
#: Words that make even an article element boilerplate.
STRONG_WORDS = frozenset("ad ads advert adverts advertisement comment comments reply replies related recommended promo sponsored widget".split())
#: Words before a name that only say what a layout has.
LAYOUT_WORDS = frozenset("has with no without".split())
GOOD_TAGS = frozenset("article main".split())


@dataclass
class Block:
    """text; tag, good signs and number of the nearest block-level element, the number of the one around it, their depth; bad signs of
    the whole chain; characters of link text; and the least depth between the block before and this one."""

    text: str
    tag: str
    good: int
    bad: int
    link: int
    parent: int
    depth: int
    low: int


def _signs(tag: str, attributes: str) -> tuple[int, int]:
    """(good, bad) signs of an element."""
    good, bad = int(tag in GOOD_TAGS), int(tag in BAD_TAGS)
    if tag in ("html", "body"):
        return good, bad
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "")
            words = set(_WORD.findall(spaced.lower()))
            if words & (STRONG_WORDS if tag in GOOD_TAGS else BAD_WORDS) and not words & LAYOUT_WORDS:
                bad += 1
            elif words & GOOD_WORDS:
                good += 1
        if "idden" in attributes or "none" in attributes:
            if _HIDDEN.search(attributes):
                bad += 3
    return good, bad


class _TagEnds:
    """Where tags end: at the first > outside quotes. What was scanned once is not scanned again, however broken the markup is."""

    def __init__(self, page: str):
        self.page, self.known = page, {}
        self.clear_from = self.clear_to = -1  # no quote and no > from the one place up to the other
        self.last: dict[str, int] = {}

    def _special(self, at: int) -> int:
        if not self.clear_from <= at <= self.clear_to:
            m = _SPECIAL.search(self.page, at)
            self.clear_from, self.clear_to = at, m.start() if m else len(self.page)
        return self.clear_to

    def find(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin here, or -1."""
        chain, page = [], self.page
        while True:
            q = self._special(at)
            if q >= len(page):
                end = -1
                break
            if page[q] == ">":
                end = q
                break
            if q in self.known:
                end = self.known[q]
                break
            chain.append(q)
            if page[q] not in self.last:
                self.last[page[q]] = page.rfind(page[q])
            if self.last[page[q]] == q:  # never closed
                end = -1
                break
            at = page.find(page[q], q + 1) + 1
        for q in chain:
            self.known[q] = end
        return end


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, slash, tag, attributes or text) of a page in order: text, tag, and raw elements with their contents left out. Linear in the page.

    A < that begins nothing is text; a tag that the page ends in is not.
    """
    ends, at, n = _TagEnds(page), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", "", "", page[at:lt]
        if lt == n:
            return
        at = n
        follows = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        raw = _RAW_OPEN.match(page, lt)
        end = ends.find(raw.end()) if raw else -1
        if end >= 0:
            close = _RAW_CLOSE[raw[1].lower()].search(page, end + 1)
            at = close.end() if close else n
            yield "raw", "", raw[1].lower(), ""
            continue
        m = _OPEN.match(page, lt)
        if m:
            end = ends.find(m.end())
            if end >= 0:
                yield "tag", m[1], m[2].lower(), page[m.end() : end]
                at = end + 1
            elif not (follows != "/" and page.find("<", lt + 1) < 0 and page.find(">", lt + 1) < 0):
                yield "text", "", "", "<"
                at = lt + 1
        elif follows and follows in "!?/":
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        else:
            yield "text", "", "", "<"
            at = lt + 1


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    # open elements: tag, good and bad signs summed over the chain, and of the nearest block-level element: depth, number, the number around it, tag, good
    stack: list[tuple] = [("", 0, 0, 0, 0, 0, "", 0)]
    opened: Counter = Counter()
    parts: list[str] = []
    number = links = linked = low = 0

    def end() -> None:
        nonlocal linked, low
        if parts:
            text = "".join(parts)
            parts.clear()
            if "&" in text:
                text = _html.unescape(text)
            text = " ".join(text.split())
            if text:
                _, _, bad, depth, _, parent, tag, good = stack[-1]
                out.append(Block(text, tag, good, bad, min(linked, len(text)), parent, depth, low))
                low = depth
        linked = 0

    def shut(k: int) -> None:
        nonlocal low
        opened.subtract(e[0] for e in stack[k:])
        del stack[k:]
        low = min(low, stack[-1][3])

    for kind, slash, tag, rest in tokens(page):
        if kind == "text":
            parts.append(rest)
            if links:
                linked += len(rest)
            continue
        if kind == "raw":
            if tag in ("title", "select", "textarea"):
                end()
            continue
        if tag in BLOCK:
            end()
        if slash:
            if tag == "a":
                links = max(0, links - 1)
            if opened[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        shut(k)
                        break
                    if stack[k][0] in SCOPE and tag not in SCOPE:
                        break
            continue
        # a slash that ends an unquoted value belongs to the value
        if tag in VOID or (rest.endswith("/") and (len(rest) == 1 or rest[-2] in " \t\r\n\"'")):
            continue
        if tag in ENDS_P or tag in CLOSES:
            shuts = CLOSES.get(tag, ()) + (("p",) if tag in ENDS_P else ())
            if any(opened[t] > 0 for t in shuts):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in shuts:
                        shut(k)
                        break
                    if stack[k][0] in SCOPE and stack[k][0] not in shuts:
                        break
        if tag == "a":
            links += 1
        number += 1
        _, good, bad, depth, own, parent, btag, bgood = stack[-1]
        g, b = _signs(tag, rest) if tag in BLOCK or rest else (0, 0)
        if g and not b and not bad:
            good += g
        if tag == "header" and good and b == 1:
            b = 0  # the heading part of an article
        opened[tag] += 1
        stack.append((tag, good, bad + b, depth + 1, number, own, tag, good) if tag in BLOCK else (tag, good, bad + b, depth, own, parent, btag, bgood))
    end()
    return out


#: Pages whose blocks the classifier is fitted on, picked by a hash of the page.
MOST_PAGES = 2000
#: Blocks of one page that the fit sees at most, evenly spaced over it.
MOST_PAGE_BLOCKS = 100
#: Weights of the text features before any page is seen, to which the fit is drawn: constant, length, link share, end mark, under 4 and 8 words, 20 and more, heading, paragraph, list or table, commas.
PRIOR = np.array([-1.2, 2.0, -2.5, 0.8, -1.0, -0.8, 0.8, 0.8, 0.6, -0.4, 0.3])
#: Bounds of what the text may say, and what each kind of sign says, as log odds.
TEXT_BOUND, GOOD_SIGN, BAD_SIGN = 3.0, 3.0, 4.5
#: Smoothness between neighbours at distance 0, and between the blocks of one parent.
NEAR, SIBLING = 1.0, 0.5


def features(block: Block) -> list[float]:
    """What the block's own text and element show."""
    words = block.text.count(" ") + 1
    return [1.0, min(np.log1p(words), 5.0) / 3, block.link / len(block.text), float(block.text[-1] in ".!?:;\"'"), float(words < 4), float(words < 8), float(words >= 20),
            float(block.tag in ("h1", "h2", "h3")), float(block.tag in ("p", "blockquote", "pre")), float(block.tag in ("li", "dt", "dd", "td", "th")), min(1.0, 5 * block.text.count(",") / words)]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 300, pull: float = 0.02) -> np.ndarray:
    """Logistic weights, both labels weighing the same, drawn to PRIOR."""
    if not 0 < y.sum() < len(y):
        return PRIOR
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w = PRIOR.copy()
    for _ in range(steps):
        w -= 0.5 * (x.T @ (share * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) + pull * (w - PRIOR))
    return w


def evidence(found: list[Block], weights: np.ndarray) -> np.ndarray:
    """Log odds of content of each block."""
    if not found:
        return np.zeros(0)
    text = np.clip(np.array([features(b) for b in found]) @ weights, -TEXT_BOUND, TEXT_BOUND)
    signs = [GOOD_SIGN * (0.25 * (b.good > 0) if b.bad else min(2, b.good)) - BAD_SIGN * min(2, b.bad) for b in found]
    return text + np.array(signs)


def min_cut(source: list[float], sink: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut, by max-flow in phases of shortest paths.

    source[i]: lost if node i ends on the sink side; sink[i]: lost if it ends on the source side; edges: lost if their ends are parted.
    """
    n = len(source)
    start, goal = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        for at, end, c in ((a, b, there), (b, a, back)):
            out[at].append(len(to))
            to.append(end)
            room.append(c)

    for i in range(n):
        left = source[i] - sink[i]  # what the direct path leaves
        add(*((start, i, left, 0.0) if left > 0 else (i, goal, -left, 0.0)))
    for (a, b), c in edges.items():
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[start], queue = 0, [start]
        for u in queue:
            for e in out[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[goal] < 0:
            return [d >= 0 for d in level[:n]]
        turn, path, u = [0] * (n + 2), [], start
        while True:
            if u == goal:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                u = to[path[full] ^ 1]
                del path[full:]
                continue
            while turn[u] < len(out[u]) and not (room[out[u][turn[u]]] > 1e-9 and level[to[out[u][turn[u]]]] == level[u] + 1):
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(out[u][turn[u]])
                u = to[path[-1]]
            elif u == start:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def label(found: list[Block], weights: np.ndarray = PRIOR, smooth: float = 1.0) -> list[bool]:
    """Content or not, for each block; `smooth` scales the edges (0: every block by itself)."""
    groups: list[list[int]] = []
    for k, b in enumerate(found):
        last = found[k - 1] if k else None
        alike = last is not None and last.parent == b.parent and last.depth == b.depth and b.low >= b.depth - 1
        if alike and (last.good, last.bad, last.tag, last.link * 2 > len(last.text)) == (b.good, b.bad, b.tag, b.link * 2 > len(b.text)):
            groups[-1].append(k)
        else:
            groups.append([k])
    odds = evidence(found, weights)
    boiler, content = ([float(np.logaddexp(0, sign * odds[members]).sum()) for members in groups] for sign in (1, -1))  # of losing content, of keeping boilerplate
    edges: dict[tuple[int, int], float] = {}
    seen: dict[int, int] = {}
    for g, members in enumerate(groups):
        b = found[members[0]]
        if g:
            before = found[groups[g - 1][-1]]
            edges[g - 1, g] = smooth * NEAR / (1 + before.depth + b.depth - 2 * b.low) ** 2
        if b.parent in seen:
            edges[seen[b.parent], g] = edges.get((seen[b.parent], g), 0.0) + smooth * SIBLING
        seen[b.parent] = g
    out = [False] * len(found)
    for members, side in zip(groups, min_cut(boiler, content, edges), strict=True):
        for k in members:
            out[k] = side
    return out


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """The content blocks of a page, one to a line."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, label(found, weights), strict=True) if keep)


def _plain_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the blocks whose elements speak for one label alone, and that label."""
    for batch in batches:
        found = []
        for page in batch.column(0).to_pylist():
            plain = [b for b in blocks(page or "") if bool(b.bad) != bool(b.good)]
            found += [(features(b), int(not b.bad)) for b in plain[:: -(-len(plain) // MOST_PAGE_BLOCKS) or 1]]
        yield pa.record_batch([pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([y for _, y in found], pa.int32())], names=["x", "y"])


def train(pages: DataFrame, html_col: str = "html", most_pages: int = MOST_PAGES) -> np.ndarray:
    """The classifier's weights from a bounded sample of the pages."""
    html = pages.select(F.col(f"`{html_col}`").cast("string").alias("html")).where("html IS NOT NULL")
    hashed = html.withColumn("h", F.xxhash64("html"))
    last = hashed.select("h").distinct().orderBy("h").limit(most_pages).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("html").alias("html"))  # most_pages rows at most
    rows = sample.select("html").mapInArrow(_plain_task, "x array<double>, y int").toArrow()
    x = np.array(rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, len(PRIOR))
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # arrival order must not matter
    return fit(x[order], y[order])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page."""
    weights = train(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
