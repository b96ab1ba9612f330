"""Main text of web pages: flat text blocks judged by a decision tree.

A page is cut into blocks at block-level tags; scripts, styles, comments and other unseen elements
leave no text. Each block is described by its words, its link density, whether it is a heading, whether
an open element marks the article or marks page furniture (by tag, role, class or id), and by words and
link density of both neighbours. A decision tree (Gini splits) trained on the labelled table
below keeps or drops it.

Defined results: null or empty html, or a page without a kept block, gives an empty text;
every row gives one row, also without an id and when ids repeat.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
RAW = "script style textarea title iframe"
UNSEEN = "noscript template select svg canvas audio video button annotation annotation-xml"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "object math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot munder mover munderover mstyle mtable mtr mtd mpadded mphantom".split()
)
# Their tags end the block that an unseen element without an end tag stands in.
BLOCK = "address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h[1-6] header html li main nav ol p pre section table tbody td th tr ul"
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog".split())
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|comments?|commentlist|respond|disqus|replies|cookies?|consent|notices?|alert|"
    r"nav\w*|menu\w*|footer|header|masthead|breadcrumbs?|share\w*|social|related|recommend\w*|newsletter|subscri\w*|popup|modal|overlay|widgets?|"
    r"login|signup|search|pagination|pager|toolbar|skip|copyright|legal|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|post|entry|story|body-?text)(?:$|[\s_-])", re.I)

_ATTRIBUTES = r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*"
_IN_BLOCK = rf"(?:(?!</?(?:{'|'.join(BLOCK.split())})\b).)*"
_UNSEEN = rf"(?:{'|'.join(UNSEEN.split())})(?![\w-])"
# Raw text goes to its end tag; a self-closed unseen element is empty; others go to their end tag, or without one of their own to the block's end.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW.split())})\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<{_UNSEEN}{_ATTRIBUTES}(?<=/)>"
    rf"|<({_UNSEEN}){_ATTRIBUTES}>(?:(?:(?!<\2\b).)*?</\2\s*>|{_IN_BLOCK}?</\2\s*>|{_IN_BLOCK})"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})>|<[!?][^>]*>",
    re.I | re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

FEATURES = ("words", "links", "heading", "article", "furniture", "words_before", "links_before", "words_after", "links_after")
# Labelled blocks: the features in that order (link densities in percent), then 1 for main text.
TABLE = """
40 0 0 1 0 12 0 55 0 1
6 0 1 1 0 8 100 40 0 1
1 0 0 1 0 60 0 80 0 1
2 0 0 1 0 3 0 1 0 1
120 5 0 1 0 30 0 20 0 1
15 60 0 1 0 90 0 70 0 1
3 100 0 1 0 50 0 44 0 1
9 0 0 1 0 0 0 0 0 1
25 0 0 1 0 7 0 5 100 1
300 2 0 1 0 9 0 8 90 1
4 0 1 1 0 5 0 30 0 1
3 0 0 1 0 1 100 0 0 1
1 0 0 1 0 2 100 3 0 1
10 30 0 1 0 6 100 5 100 1
2 100 0 1 0 0 0 2 0 1
70 0 0 0 0 45 0 60 0 1
70 0 0 0 0 60 0 0 0 1
45 2 0 0 0 90 0 4 100 1
30 0 0 0 0 75 0 2 0 1
35 3 0 0 0 20 0 80 4 1
22 0 0 0 0 50 0 30 0 1
150 8 0 0 0 2 0 3 100 1
18 0 0 0 0 40 0 41 10 1
6 0 1 0 0 5 100 60 0 1
5 0 1 0 0 44 0 50 0 1
8 0 0 0 0 60 0 45 0 1
28 10 0 0 0 4 0 33 0 1
1 100 0 0 1 1 100 1 100 0
2 100 0 0 0 2 100 3 100 0
4 80 0 0 0 3 100 2 100 0
9 0 0 0 1 6 100 14 0 0
12 0 0 0 1 40 0 0 0 0
60 0 0 0 1 80 0 30 0 0
35 0 0 1 1 50 0 20 0 0
7 0 1 1 1 30 0 40 0 0
110 2 0 1 1 90 0 25 0 0
18 0 0 0 1 12 0 20 0 0
5 0 1 0 1 0 0 9 0 0
3 0 0 0 0 2 100 4 100 0
6 0 0 0 0 1 100 0 0 0
5 50 0 0 0 4 40 6 60 0
20 90 0 0 0 15 95 12 100 0
14 70 0 0 0 30 0 5 90 0
2 0 0 0 0 3 0 2 0 0
4 0 0 0 0 0 0 3 100 0
8 0 0 1 1 1 100 2 100 0
3 100 1 0 0 4 100 5 100 0
25 0 1 0 1 20 0 6 0 0
45 55 0 0 0 20 70 22 60 0
200 0 0 0 1 50 0 20 0 0
180 1 0 1 1 10 0 50 0 0
400 0 0 0 1 0 0 0 0 0
90 4 0 0 1 300 0 120 0 0
3 100 0 0 0 0 0 60 0 0
6 100 0 0 0 5 100 45 2 0
2 0 0 0 0 4 100 50 0 0
5 0 0 1 1 80 0 75 0 0
"""


def grown(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple | float:
    """A binary tree of (feature, threshold, low side, high side) with shares of main text as leaves."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= t
            a, b = y[low].mean(), y[~low].mean()
            impurity = low.sum() * a * (1 - a) + (~low).sum() * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, t)
    if best is None:
        return share
    _, f, t = best
    low = x[:, f] <= t
    return f, float(t), grown(x[low], y[low], depth - 1), grown(x[~low], y[~low], depth - 1)


@lru_cache(maxsize=1)
def trained() -> tuple | float:
    table = np.array([row.split() for row in TABLE.split("\n") if row], dtype=float)
    return grown(table[:, :-1], table[:, -1])


def judged(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    """Whether each row of features is main text."""
    out = np.zeros(len(x), bool)
    if not isinstance(tree, tuple):
        out[:] = tree >= 0.5
        return out
    f, t, low, high = tree
    side = x[:, f] <= t
    out[side] = judged(low, x[side])
    out[~side] = judged(high, x[~side])
    return out


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element marks the article, and whether it marks furniture."""
    article = tag in ("article", "main")
    furniture = tag in FURNITURE_TAGS or (tag == "header" and not in_article)
    if attributes and tag not in ("html", "body"):
        for names in _NAMES.findall(attributes):
            name = "".join(names)
            furniture = furniture or bool(FURNITURE.search(name))
            article = article or bool(ARTICLE.search(name))
        furniture = furniture or bool(_HIDDEN.search(attributes))
    return article and not furniture, furniture


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """The text blocks of a page in order, and their features."""
    texts: list[str] = []
    rows: list[tuple] = []
    stack: list[tuple[str, bool, bool]] = []
    pieces: list[str] = []
    linked: list[str] = []
    links = 0
    article = furniture = 0

    def close():
        nonlocal pieces, linked
        text = " ".join(entities.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            words = text.count(" ") + 1
            inside = len(entities.unescape(" ".join(linked)).split())
            heading = any(t[0] in "hH" and len(t) == 2 and t[1].isdigit() for t, _, _ in stack[-2:])
            texts.append(text)
            rows.append((words, min(100.0, 100.0 * inside / words), heading, article > 0, furniture > 0))
        pieces, linked = [], []

    def put(text):
        if text:
            pieces.append(text)
            if links:
                linked.append(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m.group(4)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
        elif tag in INLINE:
            if tag == "a":
                links = max(links + (-1 if m.group(3) else 1), 0)
        else:
            close()
            if tag in VOID or tag == "p" or m.group(5).endswith("/"):
                continue
            if not m.group(3):
                a, f = _marks(tag, m.group(5), article > 0)
                stack.append((tag, a, f))
                article, furniture, links = article + a, furniture + f, 0
            elif any(t == tag for t, _, _ in stack):
                while True:
                    t, a, f = stack.pop()
                    article, furniture, links = article - a, furniture - f, 0
                    if t == tag:
                        break
    put(page[at:])
    close()
    own = np.array(rows, dtype=float).reshape(len(rows), 5)
    none = np.zeros((1, 2))
    before = np.concatenate([none, own[:-1, :2]]) if len(rows) else np.zeros((0, 2))
    after = np.concatenate([own[1:, :2], none]) if len(rows) else np.zeros((0, 2))
    return texts, np.concatenate([own, before, after], axis=1)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    texts, features = blocks(page)
    return " ".join(t for t, keep in zip(texts, judged(trained(), features)) if keep)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(page.as_py()) for page in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
