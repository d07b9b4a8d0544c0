"""Main text of web pages by minimum cut.

A page is cut into text blocks.  A logistic classifier says what it costs to call a block
content or boilerplate; these costs are the capacities of its edges to source and sink.
Edges between neighbouring blocks, and between blocks under one parent, cost what it takes
to label them differently.  The maximum flow separates content from boilerplate.

The classifier is fitted on a bounded sample of pages.  Their labels come from the pages
themselves: containers that say what they hold (``nav``, ``footer``, ``article``, classes
such as ``sidebar``).  The fit stays near a prior, which alone decides where a sample says
little.

Cases: null and empty pages, and pages without text, give an empty text; markup that is
not closed or not opened is taken as browsers do in the usual cases; nesting depth and
length are not limited; repeated rows each get their row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Pages that the classifier is fitted on, and the characters of each that are used.
SAMPLE_PAGES, SAMPLE_CHARS = 500, 200_000
#: What it costs to label neighbours, and blocks under one parent, differently.
NEIGHBOUR, SIBLING = 0.8, 0.4

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([/!?]?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^<>]*+>",
                  re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Any attribute's name, with its value taken along.
_NAME = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++))?|\"[^\"]*+\"|'[^']*+'")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_HIDDEN = {"head", "svg", "template", "select", "button", "option", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div",
          "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
          "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
_SPACE = {"br", "td", "th", "img", "wbr"}
#: A start tag closes these open ones, up to the nearest of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_AGAINST_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "search"}
_FOR_TAGS = {"article", "main"}
_AGAINST_WORDS = (
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|newsletter|"
    r"subscribe|popup|modal|overlay|menu|nav|navbar|navigation|breadcrumbs?|sidebar|widgets?|related|recommended|"
    r"share|sharing|social|footer|masthead|topbar|header|comments?|comment\w*|repl(?:y|ies)|disqus|login|signup|"
    r"search|pagination|pager|complementary|contentinfo|skip")
_AGAINST = re.compile(rf"(?:^|[\s_-])(?:{_AGAINST_WORDS})(?:$|[\s_-])", re.I)
#: Within an article only a whole name of a class counts; part of one leaves it to the text.
_AGAINST_WHOLE = re.compile(rf"(?:^|\s)(?:{_AGAINST_WORDS})(?:$|\s)", re.I)
_FOR = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content|body)(?:$|[\s_-])", re.I)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

FEATURES = ("one", "for", "against", "log_chars", "links", "ends", "heading", "item", "sentences")
PRIOR = np.array([-1.6, 4.0, -6.0, 0.6, -3.0, 0.8, 1.0, -0.5, 0.5])


@dataclass
class Text:
    """One block: its text, the characters of it in links, where it stands."""

    text: str
    linked: int
    tag: str
    parent: int
    sign: int


@dataclass
class _Open:
    tag: str
    number: int
    sign: int
    hidden: bool


def _is_hidden(attributes: str) -> bool:
    lower = attributes.lower()
    return "hidden" in lower and "hidden" in _NAME.findall(lower)


@dataclass
class _Parser:
    out: list[Text] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", 0, 0, False)])
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    links: int = 0
    made: int = 0

    def text(self, raw: str) -> None:
        if not self.stack[-1].hidden:
            self.pieces.append(raw)
            if self.links:
                self.linked.append(raw)

    def flush(self) -> None:
        """End the block.  Its place is the nearest open block element."""
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                at = len(self.stack) - 1
                while at and self.stack[at].tag not in _BLOCK:
                    at -= 1
                parent = self.stack[max(at - 1, 0)]
                self.out.append(Text(text, sum(map(len, self.linked)), self.stack[at].tag, parent.number,
                                     self.stack[at].sign))
        self.pieces, self.linked = [], []

    def close(self, depth: int) -> None:
        for gone in self.stack[depth:]:
            self.links -= gone.tag == "a"
        del self.stack[depth:]

    def start(self, tag: str, attributes: str) -> None:
        if tag in _SPACE:
            self.text(" ")
        if tag in _BLOCK:
            self.flush()
            for at in range(len(self.stack) - 1, 0, -1):  # a block ends an open paragraph
                if self.stack[at].tag == "p":
                    self.close(at)
                    break
                if self.stack[at].tag in _BLOCK or self.stack[at].tag in ("td", "th"):
                    break
        if tag in _CLOSES:
            ended, within = _CLOSES[tag]
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at].tag in within:
                    break
                if self.stack[at].tag in ended:
                    self.close(at)
                    break
        if tag in _VOID:
            return
        above = self.stack[-1]
        self.made += 1
        self.stack.append(_Open(tag, self.made, self.sign(tag, attributes, above),
                                above.hidden or tag in _HIDDEN or _is_hidden(attributes)))
        self.links += tag == "a"

    def sign(self, tag: str, attributes: str, above: _Open) -> int:
        """What the innermost container that says it holds: 1 content, -1 not, 0 unknown."""
        if tag in _AGAINST_TAGS or tag == "header" and above.sign < 1:
            return -1
        if tag in _FOR_TAGS:
            return 1
        if attributes and tag in _BLOCK and tag not in ("body", "html"):
            for _, value in _ATTRIBUTE.findall(attributes):
                value = value.strip("\"'")
                if (_AGAINST_WHOLE if above.sign > 0 else _AGAINST).search(value):
                    return -1
                if above.sign > 0 and _AGAINST.search(value):
                    return 0
                if _FOR.search(value):
                    return 1
        return above.sign

    def end(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                self.close(at)
                return
            if tag not in _BLOCK and self.stack[at].tag in _BLOCK:
                return  # an inline end tag does not end a block


def parse(page: str) -> list[Text]:
    """The page's text blocks in order."""
    parser, at = _Parser(), 0
    last = page.rfind(">") + 1  # no tag ends beyond
    unclosed = page.find("<!--", last)
    page = page[:unclosed] if unclosed >= 0 else page
    while True:
        m = _TAG.search(page, at, last)
        if not m:
            parser.text(page[at:])
            break
        if m.start() > at:
            parser.text(page[at:m.start()])
        at = m.end()
        if not m[2] or m[1] in ("!", "?"):
            continue
        tag = m[2].lower()
        if m[1]:
            parser.end(tag)
            continue
        if tag in _RAW:
            ending = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = ending.end() if ending else len(page)
            continue
        parser.start(tag, m[3])
    parser.flush()
    return parser.out


def features(blocks: list[Text]) -> np.ndarray:
    rows = []
    for b in blocks:
        n = len(b.text)
        rows.append((1.0, b.sign > 0, b.sign < 0, math.log1p(n), min(1.0, b.linked / n), b.text[-1] in ".!?…\"”",
                     b.tag in _HEADINGS, b.tag in ("li", "dt", "dd"), min(3, b.text.count(". "))))
    return np.array(rows, float).reshape(-1, len(FEATURES))


def fit(x: np.ndarray, y: np.ndarray, spread: float = 0.5, steps: int = 30) -> np.ndarray:
    """Logistic weights that stay near the prior (normal with deviation ``spread``), by
    Newton steps."""
    w = PRIOR.copy()
    if not len(x):
        return w
    share = 1000 / max(1000, len(x))  # the sample speaks for at most so many blocks
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = share * x.T @ (p - y) + (w - PRIOR) / spread**2
        curve = share * (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread**2
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def learn(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> np.ndarray:
    """Weights from at most SAMPLE_PAGES pages, picked by hash of id: hashes alone are put in
    order, and pages are read up to the last of them."""
    rows = pages.where(F.col(html_col).isNotNull()) \
        .select(F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("h"), F.col(f"`{html_col}`").alias("x"))
    last = rows.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    rows = rows.where(F.col("h") <= last).select("h", F.substring("x", 1, SAMPLE_CHARS).alias("x")) \
        .orderBy("h", "x").limit(SAMPLE_PAGES).select("x")
    x, y = [np.zeros((0, len(FEATURES)))], [np.zeros(0)]
    for row in rows.toLocalIterator():
        blocks = [b for b in parse(row["x"]) if b.sign]
        x.append(features(blocks))
        y.append(np.array([b.sign > 0 for b in blocks], float))
    return fit(np.concatenate(x), np.concatenate(y))


def min_cut(content: list[float], boilerplate: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which blocks are content.  ``content[i]`` is the cost of calling block i boilerplate,
    the capacity of its edge from the source; ``boilerplate[i]`` that of its edge to the sink.

    What can flow through a block alone is taken off first; the rest goes along the
    shortest ways from blocks with more from the source to those with more to the sink.
    """
    rest = [a - b for a, b in zip(content, boilerplate)]
    near: list[dict[int, float]] = [{} for _ in rest]
    for (a, b), cost in edges.items():
        near[a][b] = near[a].get(b, 0) + cost
        near[b][a] = near[b].get(a, 0) + cost
    while True:
        came = {i: -1 for i, r in enumerate(rest) if r > 1e-12}
        queue, goal = deque(came), -1
        while queue and goal < 0:
            a = queue.popleft()
            for b, room in near[a].items():
                if room > 1e-12 and b not in came:
                    came[b] = a
                    if rest[b] < -1e-12:
                        goal = b
                        break
                    queue.append(b)
        if goal < 0:
            return [i in came for i in range(len(rest))]  # the source's side
        flow, b = -rest[goal], goal
        while came[b] >= 0:
            flow, b = min(flow, near[came[b]][b]), came[b]
        flow = min(flow, rest[b])
        rest[b] -= flow
        rest[goal] += flow
        b = goal
        while (a := came[b]) >= 0:
            near[a][b] -= flow
            near[b][a] = near[b].get(a, 0) + flow
            b = a


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The content blocks, joined by an empty line."""
    blocks = parse(page) if page else []
    if not blocks:
        return ""
    score = features(blocks) @ weights
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = NEIGHBOUR
        if b.parent in last:
            pair = (last[b.parent], i)
            edges[pair] = edges.get(pair, 0) + SIBLING
        last[b.parent] = i
    kept = min_cut(np.logaddexp(0, score).tolist(), np.logaddexp(0, -score).tolist(), edges)
    return "\n\n".join(b.text for b, k in zip(blocks, kept) if k)


def extract(pages: DataFrame, weights: np.ndarray, *, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of each page."""
    weights = np.array(weights)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, weights) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).alias("html")) \
        .mapInArrow(rows, "page_id long, url string, text string, n_chars long")
