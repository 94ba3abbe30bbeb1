"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into text blocks at block-level tags.  Each block has its word
count, its share of linked words, those of its neighbours, and what the tags
around it say; a decision tree learned from a small labelled table decides which
blocks are main text.

Elements that are beside the text by what they are (nav, footer, aside, dialog,
comments) stay so.  Those that are only called so, and forms, do not count where
they hold the page's largest article or main, or, on pages without these, more
than half of its words that are not links.

Null or empty html, and pages without a kept block, give the empty text.  Broken
markup is read as far as it goes: unknown tags are ignored, unclosed ones end
with their container.  Time grows with the length of the page however broken it
is.  A page is held by one task.  Equal pages get equal texts.
An empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from biblioweave.llm.common import carried, steps, texts

# Element names of the HTML standard by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template iframe svg math object canvas head textarea select button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_TAGS = frozenset("nav footer aside menu dialog".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Class and id names of parts around the main text.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs cookie cookies consent copyright footer foot form header masthead menu "
    "nav navbar navigation newsletter notice popup promo promoted related share sharing sidebar sponsor sponsored social subscribe "
    "toolbar widget login signup modal contentinfo complementary search".split()
)
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond discussion".split())
# Inside the main part these name its own head.
HEAD_WORDS = frozenset("header masthead banner".split())
# A name of several parts is that of its last one, or of its first before one of these; a state of a wrapper names nothing.
HOLDERS = frozenset("area bar block body box buttons card container content item items links list posts section slot thread unit widget wrapper".split())
STATES = frozenset("has with without no is not hide show".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!?/?[a-zA-Z?][^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+(?:>|\Z)|(?P<plain><[!?/]?[a-zA-Z!?][^>]*+>)", re.S
)
# Once a quote is left open up to the end of the page.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/]?[a-zA-Z!?][^>]*+(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_LABEL = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")

FEATURES = (
    "words", "link_density", "words_before", "links_before", "words_after", "links_after", "in_main", "in_aside", "heading", "listed"
)


OPEN, WEAK, STRONG = range(3)


def _beside(name: str, tag: str, inside: bool) -> int:
    """Whether an element is beside the main text: by what it is (STRONG), by what it is called (WEAK), or not (OPEN)."""
    if name in ASIDE_TAGS:
        return STRONG
    if name in ("html", "body"):
        return OPEN
    found = WEAK if name == "form" or (name == "header" and not inside) else OPEN
    if "=" not in tag:
        return found
    for label in " ".join("".join(x) for x in _LABEL.findall(tag)).lower().split():
        parts = _PART.findall(label)
        if not parts or parts[0] in STATES:
            continue
        called = {parts[-1]} | ({parts[0]} if parts[-1] in HOLDERS else set())
        if not called.isdisjoint(COMMENT_WORDS):
            return STRONG
        if not called.isdisjoint(ASIDE_WORDS - HEAD_WORDS if inside else ASIDE_WORDS):
            found = WEAK
    return found


class Containers:
    """The elements of a page that hold blocks, numbered as they open; number 0 is the page."""

    def __init__(self):
        self.parent, self.name, self.beside, self.inside, self.words = [0], [""], [OPEN], [False], [0.0]

    def open(self, parent: int, name: str, tag: str) -> int:
        inside = self.inside[parent]
        self.parent.append(parent)
        self.name.append(name)
        self.beside.append(_beside(name, tag, inside))
        self.inside.append(inside or name in MAIN_TAGS)
        self.words.append(0.0)
        return len(self.parent) - 1

    def asides(self) -> list[bool]:
        """Whether each element is beside the main text, once all words are known."""
        count, parent = len(self.parent), self.parent
        words = list(self.words)
        for i in range(count - 1, 0, -1):
            words[parent[i]] += words[i]
        strong = [False] * count
        for i in range(1, count):
            strong[i] = self.name[i] != "main" and (strong[parent[i]] or self.beside[i] == STRONG)
        mains = [i for i in range(1, count) if self.name[i] in MAIN_TAGS and self.beside[i] == OPEN and not strong[i] and words[i]]
        around = set()
        if mains:
            at = max(mains, key=lambda i: (words[i], -i))
            while at:
                around.add(at)
                at = parent[at]
        else:
            shown = sum(w for w, s in zip(self.words, strong) if not s)
            around = {i for i in range(1, count) if not strong[i] and 2 * words[i] > shown}
        aside = [False] * count
        for i in range(1, count):
            weak = self.beside[i] == WEAK and i not in around
            aside[i] = self.name[i] != "main" and (aside[parent[i]] or strong[i] or weak)
        return aside


def blocks(html: str) -> list[tuple[str, list[float]]]:
    """The text blocks of a page in order, each with its features (without those of its neighbours)."""
    found: list[tuple[str, list[float], int]] = []
    tree = Containers()
    stack: list[tuple[str, int, bool]] = []  # name, and the container and state outside of it
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    parts: list[str] = []
    linked: list[str] = []
    here = 0
    link = listed = heading = False

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text:
            words = len(text.split(" "))
            share = min(1.0, len(" ".join(linked).split()) / words)
            found.append((text, [words, share, heading, listed], here))
            tree.words[here] += words * (1 - share)
        parts.clear()
        linked.clear()

    def take(raw: str) -> None:
        text = references.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link:
            linked.append(text)

    at, end, token, last = 0, len(html), _TOKEN, html.rfind(">")
    while at < end:
        tag = (token if at <= last else _PLAIN).search(html, at)
        if tag is None:
            take(html[at:])
            break
        if token is _TOKEN and at <= last and tag["plain"]:
            token = _PLAIN
        if tag.start() > at:
            take(html[at : tag.start()])
        at = tag.end()
        named = _NAME.match(tag[0])
        if named is None:
            continue
        name, closing = named[1].lower(), tag[0][1] == "/"
        if name in RAW_TAGS and not closing:
            over = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if over is None:
                unclosed.add(name)
            if not tag[0].endswith("/>"):
                at = over.end() if over else (end if name in ("script", "style", "textarea") else at)
            close()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            link = not closing
        if name in BLOCK_TAGS:
            close()
            if not closing or name in HEADINGS:
                heading = name in HEADINGS and not closing
            link = link and name != "li"
        if name in VOID_TAGS:
            continue
        if not closing:
            if name in BLOCK_TAGS and name != "p":
                stack.append((name, here, listed))
                opened[name] += 1
                here, listed = tree.open(here, name, tag[0]), name == "li"
        elif opened[name]:
            while stack:
                was, here, listed = stack.pop()
                opened[was] -= 1
                if was == name:
                    break
    close()
    aside = tree.asides()
    return [(text, [*row[:2], tree.inside[i], aside[i], *row[2:]]) for text, row, i in found]


def features(page: list[tuple[str, list[float]]]) -> np.ndarray:
    """One row per block in the order of FEATURES; beyond the page's ends there are no words and only links."""
    own = np.array([row for _, row in page], float).reshape(len(page), 6)
    before = np.vstack([[[0.0, 1.0]], own[:-1, :2]])[: len(page)]
    after = np.vstack([own[1:, :2], [[0.0, 1.0]]])[-len(page) or None :]
    return np.hstack([own[:, :2], before, after, own[:, 2:]])


# Labelled blocks: the columns of FEATURES, and whether a person would call the block main text.
# Beside the text nothing counts, and in an article nothing without links goes, whatever the neighbours ...
_LENGTHS, _NEIGHBOURS = (1, 4, 12, 60), ((0, 1.0), (2, 1.0), (3, 0.0), (45, 0.0))
CONTAINED = [
    [words, link, *before, *after, main, aside, heading, listed, int(not aside)]
    for words in _LENGTHS
    for before in _NEIGHBOURS
    for after in _NEIGHBOURS
    for main, aside, link in ((1, 0, 0.0), (0, 1, 0.0), (0, 1, 0.6), (0, 1, 1.0), (1, 1, 0.0), (1, 1, 0.6), (1, 1, 1.0))
    for heading, listed in ((0, 0), (0, 1), (1, 0))
]
# ... but links in an article are read one by one: sources and linked words of the text, then lists of links only.
LINKED = [
    [60, 0.60, 0, 1.0, 45, 0.0, 1, 0, 0, 0, 1], [40, 0.30, 2, 1.0, 2, 1.0, 1, 0, 0, 0, 1], [12, 0.50, 45, 0.0, 60, 0.0, 1, 0, 0, 0, 1],
    [4, 1.00, 45, 0.0, 60, 0.0, 1, 0, 0, 0, 1], [1, 1.00, 30, 0.0, 12, 0.0, 1, 0, 0, 0, 1], [9, 1.00, 45, 0.0, 3, 0.0, 1, 0, 1, 0, 1],
    [6, 1.00, 0, 1.0, 60, 0.0, 1, 0, 1, 0, 1], [12, 1.00, 20, 0.0, 25, 0.0, 1, 0, 0, 1, 1], [8, 0.40, 6, 0.5, 9, 0.4, 1, 0, 0, 1, 1],
    [14, 0.60, 12, 0.5, 10, 0.6, 1, 0, 0, 1, 1], [5, 0.50, 40, 0.0, 4, 0.5, 1, 0, 0, 1, 1], [60, 1.00, 45, 0.0, 45, 0.0, 1, 0, 0, 0, 1],
    [3, 1.00, 2, 1.0, 4, 1.0, 1, 0, 0, 1, 0], [4, 1.00, 3, 1.0, 3, 1.0, 1, 0, 0, 0, 0], [1, 1.00, 1, 1.0, 1, 1.0, 1, 0, 0, 1, 0],
    [8, 1.00, 7, 1.0, 9, 1.0, 1, 0, 0, 1, 0], [12, 1.00, 9, 1.0, 0, 1.0, 1, 0, 0, 1, 0], [6, 1.00, 8, 1.0, 5, 1.0, 1, 0, 1, 0, 0],
    [3, 0.95, 5, 0.9, 0, 1.0, 1, 0, 0, 1, 0], [10, 1.00, 4, 1.0, 12, 1.0, 1, 0, 0, 0, 0], [2, 1.00, 0, 1.0, 2, 1.0, 1, 0, 0, 1, 0],
]
# ... and blocks of pages whose containers say nothing: paragraphs, headings and list items of the text, then menus, notes and links.
BARE = [
    [48, 0.00, 6, 0.0, 30, 0.0, 0, 0, 0, 0, 1], [30, 0.05, 48, 0.0, 22, 0.0, 0, 0, 0, 0, 1], [22, 0.00, 30, 0.0, 3, 1.0, 0, 0, 0, 0, 1],
    [9, 0.00, 48, 0.0, 30, 0.0, 0, 0, 0, 0, 1], [7, 0.00, 2, 1.0, 60, 0.0, 0, 0, 1, 0, 1], [15, 0.00, 0, 1.0, 40, 0.0, 0, 0, 0, 0, 1],
    [70, 0.20, 4, 0.5, 9, 1.0, 0, 0, 0, 0, 1], [16, 0.00, 20, 0.0, 25, 0.0, 0, 0, 0, 1, 1], [5, 0.00, 35, 0.0, 42, 0.0, 0, 0, 1, 0, 1],
    [26, 0.10, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 1], [12, 0.00, 5, 0.0, 40, 0.0, 0, 0, 0, 0, 1], [11, 0.00, 60, 0.0, 0, 1.0, 0, 0, 0, 0, 1],
    [2, 0.00, 40, 0.0, 35, 0.0, 0, 0, 0, 0, 1], [14, 0.00, 0, 1.0, 1, 0.0, 0, 0, 0, 0, 1], [1, 0.00, 14, 0.0, 7, 0.0, 0, 0, 0, 0, 1],
    [4, 0.00, 12, 0.0, 16, 0.0, 0, 0, 0, 1, 1], [3, 0.00, 25, 0.0, 0, 1.0, 0, 0, 0, 0, 1], [13, 0.30, 30, 0.0, 28, 0.0, 0, 0, 0, 0, 1],
    [2, 0.00, 0, 1.0, 60, 0.0, 0, 0, 1, 0, 1], [3, 0.00, 4, 1.0, 50, 0.0, 0, 0, 1, 0, 1],
    [3, 1.00, 0, 1.0, 2, 1.0, 0, 0, 0, 0, 0], [2, 1.00, 3, 1.0, 4, 1.0, 0, 0, 0, 1, 0], [4, 1.00, 2, 1.0, 30, 0.0, 0, 0, 0, 0, 0],
    [3, 0.00, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0], [5, 0.20, 3, 1.0, 1, 1.0, 0, 0, 0, 0, 0], [12, 0.80, 25, 0.0, 4, 1.0, 0, 0, 0, 0, 0],
    [18, 0.90, 6, 1.0, 9, 1.0, 0, 0, 0, 1, 0], [6, 0.00, 4, 1.0, 0, 1.0, 0, 0, 0, 0, 0], [4, 0.75, 50, 0.0, 6, 1.0, 0, 0, 0, 0, 0],
    [7, 0.60, 3, 1.0, 5, 1.0, 0, 0, 1, 0, 0], [30, 0.85, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0], [1, 1.00, 60, 0.0, 1, 1.0, 0, 0, 0, 0, 0],
]
LABELLED = np.array(CONTAINED + LINKED + BARE, float)


class Tree:
    """A binary decision tree grown by Gini impurity on numbers."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 1):
        self.root = self._grow(rows, labels.astype(int), depth, least)

    def _grow(self, rows, labels, depth, least):
        share = labels.mean()
        if depth == 0 or share in (0.0, 1.0):
            return share >= 0.5
        best = None
        for column in range(rows.shape[1]):
            order = np.argsort(rows[:, column], kind="stable")
            values, ones = rows[order, column], np.cumsum(labels[order])
            count = np.arange(1, len(values))
            cuts = (values[1:] > values[:-1]) & (count >= least) & (len(values) - count >= least)
            left, right = ones[:-1] / count, (ones[-1] - ones[:-1]) / (len(values) - count)
            impurity = count * left * (1 - left) + (len(values) - count) * right * (1 - right)
            if cuts.any():
                impurity = np.where(cuts, impurity, np.inf)
                at = int(impurity.argmin())
                if best is None or impurity[at] < best[0] - 1e-12:
                    best = (impurity[at], column, (values[at] + values[at + 1]) / 2)
        if best is None:
            return share >= 0.5
        _, column, cut = best
        low = rows[:, column] <= cut
        return column, cut, self._grow(rows[low], labels[low], depth - 1, least), self._grow(rows[~low], labels[~low], depth - 1, least)

    def decide(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), bool)

        def walk(node, at):
            if isinstance(node, tuple):
                column, cut, low, high = node
                under = rows[at, column] <= cut
                walk(low, at[under])
                walk(high, at[~under])
            else:
                out[at] = node

        walk(self.root, np.arange(len(rows)))
        return out


def learn_tree(labelled: np.ndarray = LABELLED) -> Tree:
    return Tree(labelled[:, :-1], labelled[:, -1])


def main_text(html: str, tree: Tree) -> str:
    page = blocks(html)
    if not page:
        return ""
    return "\n".join(text for (text, _), kept in zip(page, tree.decide(features(page))) if kept)


def extract(pages: DataFrame, html="html", labelled: np.ndarray = LABELLED, keep=None) -> DataFrame:
    """``row`` (the columns in ``keep``, or all) and main_text of each page."""
    tree = learn_tree(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = [main_text(x, tree) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["row", "main_text"])

    packed = carried(pages, html, keep)
    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("main_text", T.StringType())]))
