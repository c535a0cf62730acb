"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block is described by its words and link density and
those of its neighbours, and by whether it lies inside elements that by name hold content (article,
main) or surroundings (nav, footer, sidebars, adverts, notices, comments). A small tree, trained on a
labelled table of such blocks, tells which blocks are text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names as HTML defines them.
RAW = "script style textarea title iframe"  # hold no tags: all up to their end tag is left out
SKIPPED = frozenset("noscript template svg select button object audio video canvas math".split())  # hold tags: their text is left out
NESTED = frozenset("template svg object math".split())  # of these, such as may hold one of their own kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
# End tags that may be left out: a start tag closes an open p, and open elements like its own up to what holds them.
ENDS_P = frozenset(
    """address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp""".split()
)
HOLDS_P = SKIPPED | frozenset("applet caption html marquee table td th".split())
CELLS = frozenset("td th caption".split())
ROWS = CELLS | frozenset(("tr", "colgroup"))
PARTS = ROWS | frozenset("tbody thead tfoot".split())
ENDS = {"li": frozenset(("li",)), "option": frozenset(("option",)), "optgroup": frozenset(("option", "optgroup"))}
ENDS |= dict.fromkeys(("dt", "dd"), frozenset(("dt", "dd"))) | dict.fromkeys(("td", "th"), CELLS)
ENDS |= {"tr": ROWS} | dict.fromkeys(("tbody", "thead", "tfoot", "colgroup", "caption"), PARTS)
LOOSE = frozenset("address div p".split())  # an open one doesn't keep an li, dt or dd from being closed
# Words in class, id or role that mark surroundings, and those that mark content.
AROUND_TAGS = frozenset("nav footer aside header form menu dialog".split())
AROUND_WORDS = frozenset(
    """ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie
    cookies copyright disqus footer form gdpr header legal masthead menu modal nav navbar navigation newsletter notice notices notification
    pagination paywall popup promo promoted promotion recommended related replies reply respond rss search share sharing sidebar
    skip social sponsor sponsored subscribe tags toolbar widget widgets""".split()
)
BESIDE_WORDS = frozenset("has no with without".split())  # as in "has-sidebar": what the element goes with, not what it is
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article articlebody content entry main maincontent post story".split())

TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*)|<({RAW.replace(' ', '|')})(?=[\s/>])([^>]*)>|<(/?)([a-z][a-z0-9:-]*)|<[!?/][^>]*>", re.DOTALL | re.IGNORECASE
)
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")  # of a tag behind its name
SPECIAL = re.compile(r"""[>"']""")
RAW_TAGS = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>?", re.IGNORECASE) for name in RAW.split()}
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE) for name in RAW.split()}
MARK = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
PART = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "around")
# The labelled table: blocks of pages of several kinds, features in the order above, then whether the block is text.
LABELLED = (
    # menus, link lists, lists of related pages
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.0, 1, 1.0, 45, 0.0, 0, 1, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (2, 1.0, 3, 1.0, 60, 0.0, 0, 0, 0),
    (8, 1.0, 70, 0.0, 9, 1.0, 0, 0, 0), (9, 1.0, 8, 1.0, 7, 1.0, 0, 1, 0), (14, 0.9, 12, 1.0, 15, 0.8, 0, 0, 0),
    (5, 1.0, 3, 1.0, 60, 0.0, 0, 0, 0), (4, 1.0, 80, 0.0, 0, 0.0, 0, 0, 0), (11, 1.0, 55, 0.0, 60, 0.0, 0, 0, 0),
    (3, 1.0, 70, 0.0, 4, 1.0, 1, 0, 0), (9, 1.0, 60, 0.0, 0, 0.0, 1, 0, 0), (12, 0.9, 11, 1.0, 10, 1.0, 1, 0, 0),
    (6, 1.0, 5, 1.0, 7, 1.0, 1, 0, 0), (7, 1.0, 6, 1.0, 80, 0.0, 1, 1, 0), (30, 0.8, 4, 1.0, 25, 0.9, 0, 0, 0),
    # footers, notices, adverts, forms: short or long, they lie in elements named so
    (12, 0.0, 55, 0.0, 0, 0.0, 0, 1, 0), (5, 0.2, 80, 0.0, 0, 0.0, 0, 1, 0), (40, 0.0, 35, 0.0, 0, 0.0, 0, 1, 0),
    (9, 0.0, 1, 1.0, 12, 0.0, 0, 1, 0), (25, 0.0, 0, 0.0, 50, 0.0, 0, 1, 0), (90, 0.0, 60, 0.0, 4, 0.0, 0, 1, 0),
    (18, 0.1, 2, 0.0, 3, 0.0, 0, 1, 0), (33, 0.0, 70, 0.0, 20, 0.0, 1, 1, 0), (10, 0.0, 45, 0.0, 52, 0.0, 1, 1, 0),
    (120, 0.0, 90, 0.0, 80, 0.0, 1, 1, 0), (6, 0.0, 12, 0.0, 30, 0.0, 1, 1, 0), (3, 0.5, 30, 0.0, 40, 0.0, 0, 1, 0),
    # crumbs outside of any named element
    (3, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0), (4, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0), (5, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0),
    (2, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0), (7, 0.3, 9, 0.5, 4, 1.0, 0, 0, 0), (6, 0.0, 4, 1.0, 5, 1.0, 0, 0, 0),
    # headings and paragraphs of an article, short ones and ones with links too
    (11, 0.0, 8, 0.0, 90, 0.0, 1, 0, 1), (3, 0.0, 0, 0.0, 60, 0.0, 1, 0, 1), (90, 0.0, 11, 0.0, 75, 0.0, 1, 0, 1),
    (75, 0.1, 90, 0.0, 40, 0.0, 1, 0, 1), (40, 0.0, 75, 0.1, 12, 0.0, 1, 0, 1), (1, 0.0, 80, 0.0, 50, 0.0, 1, 0, 1),
    (5, 0.0, 30, 0.0, 0, 0.0, 1, 0, 1), (2, 0.0, 6, 0.0, 5, 0.0, 1, 0, 1), (22, 0.3, 60, 0.0, 55, 0.0, 1, 0, 1),
    (9, 0.4, 70, 0.0, 65, 0.0, 1, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (8, 0.0, 12, 0.0, 1, 1.0, 1, 0, 1),
    (60, 0.0, 1, 1.0, 0, 0.0, 1, 0, 1), (14, 0.0, 10, 0.0, 12, 0.0, 1, 0, 1), (4, 0.5, 50, 0.0, 45, 0.0, 1, 0, 1),
    (70, 0.0, 60, 0.0, 3, 1.0, 1, 0, 1), (45, 0.0, 50, 0.0, 8, 1.0, 1, 0, 1), (3, 0.0, 65, 0.0, 2, 1.0, 1, 0, 1),
    (30, 0.1, 5, 1.0, 6, 1.0, 1, 0, 1), (12, 0.0, 2, 1.0, 9, 0.9, 1, 0, 1), (100, 0.0, 90, 0.0, 14, 1.0, 1, 0, 1),
    # the same without a named element around
    (80, 0.0, 70, 0.0, 2, 1.0, 0, 0, 1), (55, 0.0, 60, 0.0, 9, 1.0, 0, 0, 1), (28, 0.0, 45, 0.0, 12, 1.0, 0, 0, 1),
    (40, 0.1, 3, 1.0, 7, 0.8, 0, 0, 1), (90, 0.0, 1, 1.0, 5, 1.0, 0, 0, 1), (35, 0.0, 50, 0.0, 1, 1.0, 0, 0, 1),
    (70, 0.0, 2, 1.0, 65, 0.0, 0, 0, 1), (65, 0.05, 70, 0.0, 50, 0.0, 0, 0, 1), (50, 0.0, 65, 0.05, 4, 0.0, 0, 0, 1),
    (35, 0.2, 40, 0.0, 45, 0.1, 0, 0, 1), (18, 0.0, 60, 0.0, 55, 0.0, 0, 0, 1), (12, 0.0, 30, 0.0, 28, 0.0, 0, 0, 1),
    (25, 0.0, 3, 1.0, 30, 0.0, 0, 0, 1), (16, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (9, 0.0, 75, 0.0, 68, 0.0, 0, 0, 1),
    (6, 0.0, 1, 1.0, 80, 0.0, 0, 0, 1), (8, 0.0, 2, 1.0, 55, 0.0, 0, 0, 1), (5, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1),
)


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    below: Node | None = None
    above: Node | None = None
    label: int = 0

    def __call__(self, row) -> int:
        node = self
        while node.feature >= 0:
            node = node.below if row[node.feature] <= node.cut else node.above
        return node.label


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6, least: int = 2) -> Node:
    """A binary tree by Gini impurity; cuts lie half-way between values. Ties: the earlier feature, the smaller cut; labels tie to text."""
    if depth == 0 or len(set(labels.tolist())) == 1 or len(labels) < 2 * least:
        return Node(label=int(2 * labels.sum() >= len(labels)))
    gini = lambda y: len(y) * 2 * y.mean() * (1 - y.mean())
    best = (gini(labels) - 1e-9, -1, 0.0)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            side = rows[:, f] <= cut
            if min(side.sum(), (~side).sum()) >= least:
                best = min(best, (round(gini(labels[side]) + gini(labels[~side]), 9), f, cut))
    _, f, cut = best
    if f < 0:
        return Node(label=int(2 * labels.sum() >= len(labels)))
    side = rows[:, f] <= cut
    return Node(f, cut, grow(rows[side], labels[side], depth - 1, least), grow(rows[~side], labels[~side], depth - 1, least))


def train(table=LABELLED) -> Node:
    """The tree from a table of features and label; an empty table: everything is text."""
    data = np.array(table, dtype=float).reshape(len(table), len(FEATURES) + 1)
    return grow(data[:, :-1], data[:, -1]) if len(data) else Node(label=1)


def _kind(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element holds content and whether it holds surroundings, by its name and marks."""
    main, around = tag in MAIN_TAGS, tag in AROUND_TAGS
    if attributes:
        for name, value in MARK.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "style":
                around |= bool(HIDDEN.search(value))
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                around = True
            elif name != "aria-hidden":
                words = set(PART.findall(value))
                around |= bool(words & AROUND_WORDS) and not words & BESIDE_WORDS
                main |= bool(words & MAIN_WORDS) and not words & AROUND_WORDS
    return main, around and tag not in ("html", "body")


def _raw_end(html: str, at: int, name: str, empty: bool) -> int:
    """Where a raw element ends whose start tag ends at `at`: behind its end tag, else at the end of the page.

    One written as empty (`/>`) is so, unless an end tag of its name comes before the next start tag.
    """
    end = (RAW_TAGS if empty else RAW_ENDS)[name].search(html, at)
    if empty:
        return end.end() if end and end[1] else at
    return end.end() if end else len(html)


class _Ends:
    """Where tags end: at the first `>` outside of quotes, or, where quotes are left open up to the end of the page, at the first one at all.

    A quote that is left open is seen only at the end of the page. After the first such search all ends are worked out from
    the back, once, so that a page of many such tags costs no more than its length.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.places: list[int] | None = None
        self.ends: list[int] = []

    def __call__(self, at: int) -> int:
        """The place of the `>` that ends the tag whose name ends at `at`; -1 for none."""
        if at > self.last:
            return -1
        if self.places is None:
            found = REST.match(self.html, at)
            if found:
                return found.end() - 1
            self._work_out()
        i = bisect_left(self.places, at)
        return self.ends[i] if i < len(self.ends) and self.ends[i] >= 0 else self.html.find(">", at)

    def _work_out(self) -> None:
        self.places = [m.start() for m in SPECIAL.finditer(self.html)]
        self.ends, quote = [-1] * len(self.places), {}
        for i in range(len(self.places) - 1, -1, -1):
            mark = self.html[self.places[i]]
            if mark == ">":
                self.ends[i] = self.places[i]
            else:
                behind = quote.get(mark, len(self.places)) + 1  # what follows the closing quote
                self.ends[i] = self.ends[behind] if behind < len(self.ends) else -1
                quote[mark] = i


def _tokens(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Comments, raw elements (both without a name) and tags: from, to, "/" of an end tag, name, attributes."""
    at, ends = 0, _Ends(html)
    until = ends.last + 1  # behind the last `>` nothing but a comment that is never closed can begin
    while token := TOKEN.search(html, at, until):
        start, at = token.span()
        ending = name = attributes = ""
        if token[4]:
            ending, name, end = token[3], token[4].lower(), ends(at)
            if end < 0:
                break
            attributes, at = html[at:end], end + 1
        elif token[1]:
            at = _raw_end(html, at, token[1].lower(), token[2].endswith("/"))
        elif html.startswith("<!--", start) and not (len(token[0]) > 6 and token[0].endswith("-->")):
            at = len(html)
        yield start, at, ending, name, attributes
    start = html.find("<!--", at)
    if start >= 0:
        yield start, len(html), "", "", ""


def _closed(tokens) -> set[int]:
    """Where those skipped elements begin that have an end tag; one that is never closed hides nothing."""
    found: set[int] = set()
    waiting: dict[str, list[int]] = defaultdict(list)
    for start, _, ending, tag, attributes in tokens:
        if tag not in SKIPPED:
            continue
        if ending:
            if waiting[tag]:
                found.add(waiting[tag].pop())
        elif not attributes.endswith("/"):
            if tag not in NESTED:
                waiting[tag].clear()
            waiting[tag].append(start)
    return found


@lru_cache(maxsize=4096)
def _keeps_open(name: str) -> tuple[str, ...]:
    """For which start tags an open element of that name keeps those below it from being closed."""
    loose = name in LOOSE
    return tuple(
        kind
        for kind, keeps in (
            ("li", not loose and name != "li"),
            ("dd", not loose and name not in ENDS["dd"]),
            ("other", name == "table" or name in SKIPPED),
            ("p", name in HOLDS_P),
        )
        if keeps
    )


class _Open:
    """The open elements that are not inline, with the places of each name and of those that keep others open.

    Each question costs a search in places, never a walk over the open elements.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.keepers: dict[str, list[int]] = defaultdict(list)

    def push(self, name: str, kind: tuple[bool, bool]) -> None:
        self.places[name].append(len(self.stack))
        for start in _keeps_open(name):
            self.keepers[start].append(len(self.stack))
        self.stack.append((name, *kind))

    def pop(self) -> tuple[str, bool, bool]:
        top = self.stack.pop()
        self.places[top[0]].pop()
        for start in _keeps_open(top[0]):
            self.keepers[start].pop()
        return top

    def last(self, name: str) -> int:
        """Place of the innermost element of that name, else all that are open."""
        places = self.places.get(name)
        return places[-1] if places else len(self.stack)

    def staying(self, tag: str) -> int:
        """How many elements stay open when `tag` begins, by the end tags that HTML implies."""
        keep = len(self.stack)
        ends = ENDS.get(tag, frozenset())
        if any(self.places.get(name) for name in ends):
            keepers = self.keepers["li" if tag == "li" else "dd" if tag in ("dt", "dd") else "other"]
            above = keepers[-1] + 1 if keepers else 0
            for name in ends:
                places = self.places.get(name, ())
                i = bisect_left(places, above)
                if i < len(places):
                    keep = min(keep, places[i])
        if tag in ENDS_P and (places := self.places.get("p")):
            p, holds = bisect_left(places, keep), self.keepers["p"]
            held = bisect_left(holds, keep)
            if p and (not held or places[p - 1] > holds[held - 1]):
                return places[p - 1]
        return keep


def blocks(html: str) -> list[tuple[str, int, float, int, int]]:
    """Text blocks in page order: text, words, link density, whether inside content, whether inside surroundings."""
    found: list[tuple[str, int, float, int, int]] = []
    text: list[tuple[str, bool]] = []
    opened = _Open()
    anchors, main, around, at = 0, 0, 0, 0
    skipped = None  # place in the stack of the outermost skipped element
    tokens = list(_tokens(html))
    closed = _closed(tokens)

    def close() -> None:
        whole = " ".join(unescape("".join(t for t, _ in text)).split())
        if whole:
            words = len(whole.split(" "))
            linked = len(unescape(" ".join(t for t, link in text if link)).split()) if any(link for _, link in text) else 0
            found.append((whole, words, min(1.0, linked / words), int(main > 0), int(around > 0)))
        text.clear()

    def push(tag: str, kind: tuple[bool, bool]) -> None:
        nonlocal main, around
        opened.push(tag, kind)
        main, around = main + kind[0], around + kind[1]

    def shut(keep: int) -> None:
        nonlocal main, around, skipped
        while len(opened.stack) > keep:
            _, m, a = opened.pop()
            main, around = main - m, around - a
        if skipped is not None and keep <= skipped:
            skipped = None

    for start, end, ending, tag, attributes in tokens:
        if start > at and skipped is None:
            text.append((html[at:start], anchors > 0))
        at = end
        if not tag:
            continue
        if tag == "a" and skipped is None:
            anchors = max(0, anchors - 1) if ending else anchors + 1
        elif tag == "br" and skipped is None:
            text.append((" ", False))
        elif tag in INLINE or (tag in VOID and (tag != "hr" or skipped is not None)):
            continue
        elif tag in SKIPPED and not ending:
            if start in closed:
                skipped = len(opened.stack) if skipped is None else skipped
                push(tag, (False, False))
        else:
            keep = opened.last(tag) if ending else len(opened.stack)
            if tag not in SKIPPED and (skipped is None or keep < skipped):
                close()
                anchors = 0
            shut(keep if ending else opened.staying(tag))
            if not ending and tag not in VOID and not attributes.endswith("/"):
                push(tag, _kind(tag, attributes))
    if at < len(html) and skipped is None:
        text.append((html[at:], anchors > 0))
    close()
    return found


def main_text(html: str, tree: Node) -> str:
    page = blocks(html)
    kept = []
    for i, (text, words, links, inside, around) in enumerate(page):
        before = page[i - 1][1:3] if i else (0, 0.0)
        after = page[i + 1][1:3] if i + 1 < len(page) else (0, 0.0)
        if tree((words, links, *before, *after, inside, around)):
            kept.append(text)
    return " ".join(kept)


def extractor(tree: Node | None = None):
    """A column function from html to main text."""
    tree = tree or train()

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p or "", tree) for p in pages], dtype=object)

    return run


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), tree: Node | None = None) -> DataFrame:
    """The columns `keep`, text (main text, empty if none) and n_chars (its code points).

    Null html: empty. White space inside a block becomes one space, blocks are joined by one. Every row is a
    page of its own; empty table: no rows.
    """
    text: Column = extractor(tree)(F.col(html_col))
    return pages.select(*keep, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
