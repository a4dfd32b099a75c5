"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks of text at block-level tags. A block's features are its number of words and
its link density, those of the blocks before and after it, whether it is a heading, and what encloses it: an
article, an element that is made for other things (``nav``, ``footer``, ``form``, hidden ones), and how strongly a class, id or role says
that it is none of the text. A decision tree, trained on the small labelled table below when the module is first used, keeps or drops
each block. What encloses a block is a feature like the others: link lists go and long sections named like a widget stay, in an
article too, as the labelled blocks show.

Defined results: null or empty html gives the empty text; markup that is never closed is closed by what
encloses it, unclosed script, style, title and textarea elements and comments by the end of the page; rows that repeat
get the same text; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|title|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*>|<[!?][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")
#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that hold blocks and are watched while open.
HOLDERS = frozenset("label legend article main section div nav header footer aside form ul ol dl table figure fieldset dialog menu button select noscript template svg object iframe blockquote".split())
#: Elements that are no part of an article.
OUTSIDE = frozenset("label legend nav footer aside form dialog menu button select noscript template svg object iframe fieldset".split())
#: Elements that the next one of their kind closes.
SIBLINGS = frozenset("li dt dd tr td th option".split())
#: Words in a class or id, and roles, of what is no part of an article.
STRONG = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay newsletter "
    "subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer masthead topbar comment comments commentlist reply replies respond disqus contentinfo complementary dialog".split()
)
#: The same of what is mostly none, but that an article's own sections are called, too.
WEAK = frozenset("notice notification login share sharing social related recommended recommendations trending discussion widget toolbar search copyright alert form".split())
#: The same of what is an article.
CONTENT = frozenset("article post entry content story main maincontent articlebody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no other block.
BARE = HEADINGS | {"p", "pre", "hr"}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "outside", "hint", "heading")
#: The labelled table: the features in this order (hint: 2 strong, 1 weak), then 1 if the block is main text.
LABELLED = """
70 0 8 0 85 0 1 0 0 0 1
110 0.02 60 0 95 0 1 0 0 0 1
40 0.1 90 0 60 0 1 0 0 0 1
28 0 75 0 45 0 1 0 0 0 1
22 0 30 0 50 0 1 0 0 0 1
9 0 60 0 70 0 1 0 0 0 1
6 0 45 0 55 0 1 0 0 0 1
3 0 40 0 35 0 1 0 0 0 1
2 0 25 0 22 0 1 0 0 0 1
12 0 3 1 80 0 1 0 0 0 1
55 0 1 1 4 0 1 0 0 0 1
35 0 5 0 0 0 1 0 0 0 1
8 0 30 0 12 0 1 0 0 0 1
5 0 12 0 14 0 1 0 0 0 1
1 0 9 0 20 0 1 0 0 0 1
4 0 0 0 3 0 1 0 0 0 1
3 0 4 0 0 0 1 0 0 0 1
2 0 2 1 2 0 1 0 0 0 1
17 0.2 22 0 16 0 1 0 0 0 1
25 0.3 30 0 28 0 1 0 0 0 1
60 0.4 70 0 50 0 1 0 0 0 1
30 0.45 40 0 45 0 1 0 0 0 1
9 0.4 60 0 30 0 1 0 0 0 1
25 0 40 0 5 1 1 0 0 0 1
9 0 40 0 4 1 1 0 0 0 1
4 0 40 0 3 1 1 0 0 0 1
15 0 3 1 4 1 1 0 0 0 1
40 0.1 20 0 12 0.5 1 0 0 0 1
18 0 25 0 20 0.3 1 0 0 0 1
6 0 8 0 5 0.8 1 0 0 0 1
12 0 5 0 4 1 1 0 0 0 1
70 0 60 0 3 1 1 0 0 0 1
6 0 0 0 3 1 1 0 0 1 1
9 0 2 1 30 0.4 1 0 0 1 1
7 0 2 1 65 0 1 0 0 1 1
5 0 70 0 50 0 1 0 0 1 1
10 0 1 0 90 0 1 0 0 1 1
1 0 0 0 19 0 1 0 0 1 1
3 0 2 1 4 0 1 0 0 1 1
6 0 9 0 40 0 1 0 0 1 1
3 0.3 12 0 40 0 1 0 0 1 1
1 1 1 1 1 1 0 1 0 0 0
2 1 2 1 3 1 0 1 0 0 0
4 1 1 1 30 0 0 1 0 0 0
1 1 0 0 1 1 0 1 2 0 0
2 1 2 1 2 1 0 0 2 0 0
3 1 1 1 9 0 0 1 2 0 0
3 0.9 60 0 3 1 0 0 0 0 0
5 0.8 4 1 5 1 0 0 0 0 0
8 0.9 7 0.9 9 0.9 0 0 0 0 0
12 0.8 10 1 11 0.9 0 0 0 0 0
18 0.7 3 1 4 1 0 0 0 0 0
20 1 15 1 15 1 0 0 0 0 0
45 0.8 40 0.9 35 0.9 0 0 1 0 0
22 0.7 60 0 3 1 0 0 0 0 0
3 1 4 1 4 1 1 0 0 0 0
5 1 40 0 6 1 1 0 0 0 0
6 1 5 1 60 0 1 0 0 0 0
9 0.9 8 1 7 1 1 0 0 0 0
4 0.8 3 1 5 0.9 1 0 1 0 0
15 0.9 12 1 13 1 1 0 0 0 0
12 1 50 0 40 0 1 0 0 0 0
2 1 70 0 50 0 1 0 0 0 0
7 0.7 8 1 6 1 1 0 2 0 0
14 0.6 5 1 6 1 0 0 0 0 0
6 0 2 1 9 0 0 0 2 0 0
12 0 1 1 12 0 0 0 2 0 0
18 0 1 1 10 0 0 0 2 0 0
30 0 3 1 14 0 0 0 2 0 0
50 0 4 1 60 0 0 0 2 0 0
9 0 40 0 60 0 1 0 2 0 0
3 0 60 0 45 0 1 0 2 0 0
25 0.1 70 0 80 0 1 0 2 0 0
45 0 30 0 40 0 1 0 2 0 0
80 0 45 0 60 0 1 0 2 0 0
15 0 12 0 16 0 1 0 2 0 0
2 0 60 0 3 0 1 0 2 1 0
4 0 1 1 6 0 0 0 2 1 0
40 0 2 0 55 0 0 0 2 0 0
55 0 3 0.5 30 0 0 0 2 0 0
6 0 40 0 0 0 0 1 0 0 0
12 0 60 0 0 0 0 1 0 0 0
18 0 30 0 0 0 0 1 0 0 0
25 0.1 8 0 0 0 0 1 0 0 0
40 0 50 0 12 0 0 1 0 0 0
9 0 6 0 45 0 0 1 0 0 0
4 0 3 1 9 0 0 1 0 0 0
70 0 40 0 55 0 0 1 0 0 0
3 0 2 0 2 1 0 1 0 1 0
5 0 40 0 4 0 1 1 0 0 0
2 0 3 0 30 0 1 1 0 0 0
30 0 60 0 70 0 1 1 0 0 0
60 0 80 0 50 0 1 1 0 0 0
4 0 50 0 8 0 1 1 0 1 0
9 0 30 0 40 0 1 1 2 0 0
60 0 45 0 70 0 1 0 1 0 1
35 0.1 6 0 50 0 1 0 1 0 1
90 0 70 0 0 0 1 0 1 0 1
25 0 40 0 30 0 1 0 1 0 1
18 0 60 0 55 0 1 0 1 0 1
30 0 8 0 4 1 1 0 1 0 1
26 0 26 0 9 0 1 0 1 0 1
24 0 30 0 6 0 1 0 1 0 1
45 0.2 4 0 20 0.3 1 0 1 0 1
22 0 3 0 25 0 1 0 1 0 1
3 0 60 0 45 0 1 0 1 1 1
2 0 35 0 50 0 1 0 1 1 1
4 0 60 0 3 0 1 0 1 0 0
2 0 50 0 4 0.5 1 0 1 0 0
3 0 4 0 2 1 1 0 1 0 0
2 0 40 0 5 0.6 1 0 1 1 0
5 0.5 30 0 3 1 1 0 1 0 0
6 0 5 0 4 0 1 0 1 0 0
12 0 3 1 9 0 0 0 1 0 0
20 0 2 1 30 0 0 0 1 0 0
5 0 4 0 2 1 0 0 1 0 0
30 0 20 0 3 1 0 0 1 0 0
2 0 1 1 1 1 0 0 0 0 0
3 0 0 0 2 1 0 0 0 0 0
4 0 3 0 2 0 0 0 0 0 0
6 0 5 0.5 4 1 0 0 0 0 0
8 0 3 1 0 0 0 0 0 0 0
5 0 4 0 0 0 0 0 0 0 0
3 0 2 1 3 1 0 0 0 1 0
2 0 3 0 4 1 0 0 0 1 0
9 0 2 1 2 1 0 0 0 0 0
6 0 0 0 3 1 0 0 0 0 0
10 0 3 1 0 0 0 0 0 0 0
7 0 30 0 0 0 0 0 0 0 0
5 0 25 0 2 1 0 0 0 0 0
3 0 30 0 0 0 0 0 0 0 0
4 0 0 0 0 0 0 0 0 0 0
19 0 1 0 19 0 0 0 0 0 1
15 0 20 0 18 0 0 0 0 0 1
12 0 15 0 14 0 0 0 0 0 1
11 0 30 0 0 0 0 0 0 0 1
13 0 2 0 40 0 0 0 0 0 1
8 0 25 0 30 0 0 0 0 0 1
3 0 40 0 35 0 0 0 0 0 1
2 0 25 0 22 0 0 0 0 0 1
1 0 0 0 19 0 0 0 0 1 1
5 0 19 0 20 0 0 0 0 1 1
7 0 2 1 65 0 0 0 0 1 1
4 0 2 1 60 0 0 0 0 1 1
50 0 2 0 4 1 0 0 0 0 1
30 0 40 0 3 1 0 0 0 0 1
90 0 50 0 6 1 0 0 0 0 1
40 0 0 0 0 0 0 0 0 0 1
110 0.02 60 0 95 0 0 0 0 0 1
25 0.3 30 0 28 0 0 0 0 0 1
"""


class Tree:
    """A decision tree: leaves of one label, or with no split that helps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, least: int = 1):
        self.feature, self.label = -1, int(2 * y.sum() >= len(y))
        if y.min() == y.max() or len(y) < 2 * least:
            return
        best = (self._impurity(y) * len(y) - 1e-9, 0, 0.0)
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, j] <= cut
                if min(low.sum(), (~low).sum()) >= least:
                    cost = self._impurity(y[low]) * low.sum() + self._impurity(y[~low]) * (~low).sum()
                    if cost < best[0] - 1e-12:
                        best = (cost, j, float(cut))
                        self.feature = j
        if self.feature >= 0:
            _, self.feature, self.cut = best
            low = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[low], y[low], least), Tree(x[~low], y[~low], least)

    @staticmethod
    def _impurity(y: np.ndarray) -> float:
        p = y.mean()
        return float(2 * p * (1 - p))

    def __call__(self, row: list[float]) -> int:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.label


#: Copies of each labelled block, and blocks that a leaf of the tree holds at least.
COPIES, LEAST = 40, 40


@cache
def tree() -> Tree:
    """The tree for LABELLED, where each block stands for those like it: copies with other numbers of words, of its neighbours' above all, and other link densities."""
    table = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()])
    table = np.repeat(table, COPIES, axis=0)
    rng = np.random.default_rng(0)
    for at, spread in ((0, 0.25), (2, 0.7), (4, 0.7)):
        table[:, at] = np.rint(table[:, at] * np.exp(rng.normal(0, spread, len(table))))
        table[:, at] = np.maximum(table[:, at], at == 0)
    for at in (1, 3, 5):
        table[:, at] = np.clip(table[:, at] + (table[:, at] > 0) * rng.normal(0, 0.07, len(table)), 0, 1)
    return Tree(table[:, :-1], table[:, -1], LEAST)


def _context(name: str, attributes: str) -> tuple[bool, bool, int]:
    """Whether an element is an article, is made for other things or hidden, and how strongly its class, id or role says that it is no text."""
    article, outside, hint = name in ("article", "main"), name in OUTSIDE, 0
    for key, *values in ATTR.findall(attributes):
        value, key = next((v for v in values if v), ""), key.lower()
        if key == "style":
            outside |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            outside = True
        elif key in ("class", "id", "role"):
            words = {w.lower() for w in NAME.findall(value)}
            hint = max(hint, 2 if words & STRONG else 1 if words & WEAK else 0)
            article |= bool(words & CONTENT) and not words & (STRONG | WEAK)
    return article, outside, hint


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """The text of each block, white space made single, and its features."""
    found: list[tuple[str, float, bool, bool, int, bool]] = []
    open_: list[tuple[str, bool, bool, int]] = []
    state = (False, False, 0)
    parts: list[str] = []
    linked = 0
    in_link = heading = False

    def close() -> None:
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            found.append((text, min(1.0, linked / max(1, sum(map(len, parts)))), *state, heading))
        parts.clear()
        linked = 0

    def enclosing() -> tuple[bool, bool, int]:
        # hints outside the innermost article don't count: page-wide wrappers have all kinds of names
        last = max((i for i, x in enumerate(open_) if x[1]), default=-1)
        # a page's header holds no text of the article; one within an article holds its heading
        outside = any(x[2] for x in open_) or (last < 0 and any(x[0] == "header" for x in open_))
        return last >= 0, outside, max((x[3] for x in open_[max(last, 0) :]), default=0)

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue  # a comment, script, style, title, textarea or declaration
        if name in INLINE:
            if name == "a":
                in_link = not m[2]
            continue
        if name == "br":
            parts.append(" ")
            continue
        close()
        in_link = False
        heading = name in HEADINGS and not m[2]
        # a paragraph or heading ends where any other block begins
        if open_ and open_[-1][0] in BARE:
            open_.pop()
        if m[2]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    del open_[i:]
                    break
        else:
            if name in SIBLINGS and open_ and open_[-1][0] == name:
                open_.pop()
            seen = _context(name, m[4]) if m[4] or name in HOLDERS else (False, False, 0)
            if name != "body" and not m[4].endswith("/") and (name in HOLDERS or any(seen)):
                open_.append((name, *seen))
        state = enclosing()
    parts.append(page[at:])
    close()
    counts = [(float(len(t.split())), d) for t, d, *_ in found]
    none = (0.0, 0.0)
    out = []
    for i, (text, _, article, outside, hint, is_heading) in enumerate(found):
        around = (counts[i], counts[i - 1] if i else none, counts[i + 1] if i + 1 < len(counts) else none)
        out.append((text, [v for pair in around for v in pair] + [float(v) for v in (article, outside, hint, is_heading)]))
    return out


def main_text(page: str | None) -> str:
    """The kept blocks in page order, joined by one blank."""
    keep = tree()
    return " ".join(text for text, row in blocks(page or "") if keep(row))


def extract(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """``page_id, url, text`` for each row of ``pages(page_id, url, <html>)``."""
    rows = pages.select("page_id", "url", html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")
