"""Main text of web pages by minimum-cut labelling.

The html is cut into blocks of text with the names of their enclosing elements. A classifier gives
each block its odds of being content. Element names and words in class, id and role are evidence,
the innermost weighing most and each one above it half as much, so that an inner element can lift
what a wrapper says. A logistic model of the text itself (length, share of links, punctuation) adds
to it: its weights start at ``PRIOR`` and are fitted on blocks whose names leave little doubt. The
text moves the odds by at most ``TEXT_LIMIT``: a heading in an article stays, and a well-written
advert goes. On pages with an element for the article, what is outside it has lower odds.

The costs of both labels are the capacities from and to the terminals; neighbouring blocks and
blocks with one parent are joined by smoothness edges, strong where both have the same names around
them. A maximum flow separates content from the rest. Blocks whose own costs outweigh all their
edges have one label in every minimum cut, so they are fixed first and the flow runs over the rest.

The text model learns from ``TRAIN_PAGES`` pages of at most ``TRAIN_CHARS`` characters, those with
the least hashes, whatever the size of the table; every page is extracted whole.

Defined results: null and empty html give an empty text; html that breaks off in a tag, comment or
script loses only that; pages without any block are empty; repeated rows are extracted alike; an
empty table gives no rows; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epsgrid.llm.common import draw, draw_below, small_batches, table

#: Pages, and characters of each at most, whose blocks the text classifier learns from.
TRAIN_PAGES, TRAIN_CHARS = 400, 100_000
#: Capacities of edges between blocks with the same names around them; others have a quarter.
ADJACENT, SIBLING = 0.5, 1.0
#: Log odds that an element's name or a word adds, and how much those above it count.
CONTENT, LIKELY, UNTOLD, LAYOUT, HEADER, REST, ABOVE = 4.0, 2.5, 0.5, -1.5, -4.0, -6.0, 0.5
#: A first heading in a page header, and blocks outside the element for the article.
TITLE, OUTSIDE = 3.5, -2.5
#: Names alone that leave little doubt.
SURE = 3.0
#: The text alone moves the odds by this at most.
TEXT_LIMIT = 3.0
#: Weights of ``text_features`` without any page to learn from, and the weight of that belief.
PRIOR, BELIEF = (-1.2, 0.5, -4.0, 0.5, 0.0, 1.0, 0.8, -0.5), 4.0

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)"""
    r"""|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_NAMED = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
#: Element names and words in class, id and role.
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "svg", "math", "select", "object", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
_SPACES = {"br", "td", "th", "img", "wbr"}
_REST_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label", "legend", "search", "head"}
_CONTENT_TAGS = {"article", "main"}
_REST_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "discussion", "disqus", "footer", "gdpr", "login", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pagination", "popup", "promo", "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget"}
_COMMENT_WORDS = {"comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond"}
_HEADER_WORDS = {"header", "masthead"}
#: Words of parts of a layout, and words that name the whole layout by one of its parts.
_PART_WORDS = {"banner", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "menu", "menubar", "nav", "navbar", "navigation", "sidebar", "toolbar", "topbar"}
_LAYOUT_WORDS = {"container", "has", "layout", "no", "outer", "page", "site", "with", "without", "wrap", "wrapper"}
_LIKELY_WORDS = {"article", "body", "content", "entry", "main", "post", "story", "text"}
_SAME = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
_TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES_P = _BLOCKS - {"button", "label", "caption", "legend", "summary", "body", "html", "head", "tbody", "thead", "tfoot", "tr"}


@dataclass
class Block:
    text: str
    odds: float
    parent: int
    linked: int
    tag: str


@dataclass
class _Open:
    tag: str
    number: int
    odds: float
    #: Index of the nearest open element, itself included, that is neither paragraph nor heading.
    base: int


def _evidence(tag: str, attrs: str, above: float) -> float:
    """Log odds that an element's own name and words give; 0 where they say nothing."""
    if tag in ("body", "html"):
        return 0.0
    words: set[str] = set()
    weak = False
    for m in _NAMED.finditer(attrs) if attrs else ():
        if m[1].lower() == "id" and tag in _TEXT_TAGS:
            continue  # an anchor, called after the text
        for token in html_lib.unescape(m[2] or m[3] or m[4] or "").lower().split():
            said = set(_SPLIT.split(token))
            if said & _LAYOUT_WORDS and said & _PART_WORDS and not said & (_REST_WORDS - _PART_WORDS):
                weak = True
            else:
                words |= said
    if tag in _REST_TAGS:
        return REST
    if tag in _CONTENT_TAGS:
        return REST if words & _COMMENT_WORDS else CONTENT
    if words & _REST_WORDS:
        return REST
    if (tag == "header" or words & _HEADER_WORDS) and above < SURE:
        return HEADER
    if "article" in words and tag in ("div", "section"):
        return CONTENT
    if words & _LIKELY_WORDS:
        return LIKELY
    return LAYOUT if weak else 0.0


def _odds(tag: str, attrs: str, above: float, titled: bool) -> float:
    """Log odds inside an element, from its name and those around it."""
    own = _evidence(tag, attrs, above)
    if not own and tag == "h1" and above < 0 and not titled:
        own = TITLE
    return own + ABOVE * above if own else above


def blocks_of(html: str) -> list[Block]:
    """Blocks with text, in page order."""
    out: list[Block] = []
    stack = [_Open("", 0, UNTOLD, 0)]
    open_tags: Counter[str] = Counter()
    number = linked = in_link = 0
    titled = False
    parts: list[str] = []
    at = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                holder = stack[-2] if top.tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "tr") and len(stack) > 1 else top
                out.append(Block(text, top.odds, holder.number, linked, top.tag))
        parts, linked = [], 0

    def close(i: int) -> None:
        for x in stack[i:]:
            open_tags[x.tag] -= 1
        del stack[i:]

    def said(raw: str) -> None:
        nonlocal linked
        text = html_lib.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    while m := _TOKEN.search(html, at):
        if m.start() > at:
            said(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), bool(m["end"]), m["attrs"]
        if at == len(html) and html[at - 1 : at] != ">":  # broke off inside the tag
            break
        if tag in _RAW:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
                parts.append(" ")
            continue
        if tag in _SPACES:
            parts.append(" ")
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag not in _BLOCKS:
            continue
        flush()
        if tag in _VOID:
            continue
        if closing:
            if open_tags[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if stack[-1].tag == "p" and tag in _CLOSES_P or stack[-1].tag in _SAME.get(tag, ()):
            close(len(stack) - 1)
        elif tag in ("li", "tr", "dt", "dd") and stack[stack[-1].base].tag in _SAME[tag]:
            close(stack[-1].base)  # the open one, with unclosed elements in it
        number += 1
        base = stack[-1].base if tag in _TEXT_TAGS else len(stack)
        stack.append(_Open(tag, number, _odds(tag, attrs, stack[-1].odds, titled), base))
        open_tags[tag] += 1
        titled |= tag == "h1"
    if at < len(html):
        said(html[at:])
    flush()
    return out


def text_features(block: Block) -> list[float]:
    text = block.text
    words = text.count(" ") + 1
    n = len(text)
    return [1.0, float(np.log1p(words)), min(1.0, block.linked / n), (text.count(",") + text.count(".")) / words, n / words / 10, 1.0 if text[-1] in ".!?" else 0.0, 1.0 if block.tag in ("p", "blockquote", "pre") else 0.0, 1.0 if block.tag == "li" else 0.0]


def fit_text(pages: list[str]) -> np.ndarray:
    """Logistic weights by reweighted least squares on blocks of sure names, drawn to PRIOR; PRIOR itself where one kind is missing."""
    rows, labels = [], []
    for page in pages:
        for b in blocks_of(page):
            if abs(b.odds) >= SURE:
                rows.append(text_features(b))
                labels.append(float(b.odds > 0))
    prior = np.asarray(PRIOR)
    if len(set(labels)) < 2:
        return prior
    x, y, w = np.asarray(rows), np.asarray(labels), prior.copy()
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * p * (1 - p))[:, None]) + BELIEF * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - BELIEF * (w - prior))
    return w


def max_flow_side(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut.

    A node's gain is the capacity from the source, or to the sink where negative; edges hold both
    ways. Augments along shortest paths by levels (Dinic).
    """
    n = len(gain)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[float] = []

    def join(a: int, b: int, ahead: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        left.append(ahead)
        graph[b].append(len(to))
        to.append(a)
        left.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            join(source, i, g, 0.0)
        elif g < 0:
            join(i, sink, -g, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if left[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if left[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[a] < len(graph[a]):
                e = graph[a][tried[a]]
                if left[e] > tiny and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                tried[a] += 1
            else:
                if a == source:
                    break
                a = to[path.pop() ^ 1]
                tried[a] += 1


def label(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Content labels of a minimum cut; nodes that outweigh their edges are fixed before the flow."""
    near: list[list[tuple[int, float]]] = [[] for _ in gain]
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
    free = [sum(c for _, c in x) for x in near]
    gain, fixed = list(gain), [None] * len(gain)
    queue = deque(range(len(gain)))
    while queue:
        i = queue.popleft()
        if fixed[i] is not None or abs(gain[i]) < free[i]:
            continue
        fixed[i] = gain[i] > 0
        for j, c in near[i]:
            if fixed[j] is None:
                gain[j] += c if fixed[i] else -c
                free[j] -= c
                queue.append(j)
    rest = [i for i, f in enumerate(fixed) if f is None]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        side = max_flow_side([gain[i] for i in rest], [(at[a], at[b], c) for a, b, c in edges if a in at and b in at])
        for i, s in zip(rest, side, strict=True):
            fixed[i] = s
    return [bool(f) for f in fixed]


def extract(html: str | None, weights: np.ndarray) -> str:
    """Text of the content blocks, one to a line."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    text = np.clip(np.asarray([text_features(b) for b in blocks]) @ weights, -TEXT_LIMIT, TEXT_LIMIT)
    names = np.asarray([b.odds for b in blocks])
    if (names >= SURE).any():
        names = np.where((names < SURE) & (names > 0), names + OUTSIDE, names)
    odds = (names + text).tolist()
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT if b.odds == blocks[i - 1].odds else ADJACENT / 4))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING if b.odds == blocks[last[b.parent]].odds else SIBLING / 4))
        last[b.parent] = i
    # -log P(rest) - -log P(content) is the log odds
    return "\n".join(b.text for b, keep in zip(blocks, label(odds, edges), strict=True) if keep)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars``."""
    html = F.col(f"`{html_col}`").cast("string")
    able = small_batches(pages).select(html.alias("h")).where(F.length("h") <= TRAIN_CHARS).withColumn("draw", draw("h"))
    some = able.where(F.col("draw") < draw_below(TRAIN_PAGES, able.count())).groupBy("draw").agg(F.count("*")).select("draw")
    least = sorted(r["draw"] for r in some.collect())[:TRAIN_PAGES]  # numbers only, about four times as many
    chosen = able.where(F.col("draw") <= least[-1]).groupBy("draw").agg(F.min("h").alias("h")).collect() if least else []
    weights = fit_text([r["h"] for r in sorted(chosen, key=lambda r: r["draw"])])
    keep = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, weights) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("_in_html")).mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
