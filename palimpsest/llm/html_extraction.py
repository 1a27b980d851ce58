"""Main text of HTML pages by tag-path ratios.

A page is cut into text blocks, each at the end of a root-to-leaf tag path (tags with their first
class). For each path, text length, punctuation and link text are summed over its blocks. The two ratios, text a
block and punctuation a block, are smoothed over the blocks in page order, fused by their product with the share of
text outside links, and averaged by path.

Paths whose score reaches THRESHOLD times the spread of the page's scores are content. They make out a container: the
article or main element around the path with most text, else its parent. Other paths beneath the container
(headings, captions, lists) follow it unless they are mostly links or named as outside; where the container is the whole
page, that holds for headings only. Where no path reaches the threshold, the page has no text.

Two aids, both by HTML semantics: elements that are not rendered or never hold an article (scripts, controls, menus, footers,
by tag) are skipped while parsing; and the score of a form, or of a part whose class, id or role names something outside an
article, is multiplied by NAMED, unless that part holds most of the page's text and its article or first heading, or the page has neither.

A page is parsed in one pass; paths are numbered nodes of a tree, so time is linear in a page's length and depth.

Edge cases: a null or empty page gives empty text; a very long page is a block of its own; tags that are not closed end
with their parents, and a tag without its `>` before the next `<`; unknown character references stay as
they are; of paths with equal text the first on the page is the heaviest; rows that repeat are extracted alike; other
columns are carried on by name, whatever they are called.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import blocks

# Element kinds of HTML, and words that name parts outside an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math noembed noframes object".split())
NEVER = RAW | frozenset("head nav footer aside button select dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset("article main".split())
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENTS = frozenset("comment comments discussion disqus replies respond".split())
OUTSIDE = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget".split()
)
IN_ARTICLE = frozenset("header masthead banner".split())  # part of the article where it stands inside one
ROOTS = frozenset("html body".split())

NAME = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
PLAIN = re.compile(r"[^>\"'<]*")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
MARKS = re.compile(r"[.,;:!?…。，、¿¡]")

#: Weights of a block and its neighbours in page order.
SMOOTHING = np.array([0.25, 0.5, 0.25])
#: The share of the scores' spread that makes a path content.
THRESHOLD = 0.5
#: What the name of a part outside an article leaves of its score.
NAMED = 0.01


class Block(NamedTuple):
    path: int
    text: str
    linked: int  # characters inside links


class Path(NamedTuple):
    """A node of the tree of tag paths."""

    parent: int  # -1 at the root
    tag: str
    article: bool  # inside an article or main element
    named: str  # "", or why its name puts it outside: "part" or "comments"


class Page(NamedTuple):
    paths: list[Path]
    blocks: list[Block]


def _named(tag: str, own: dict[str, str], in_article: bool) -> str:
    if tag == "form" or own.get("role", "").lower() in ROLES:
        return "part"
    parts = {p.lower() for p in NAME_PART.findall(f"{own.get('class', '')} {own.get('id', '')}")} & OUTSIDE
    if in_article:
        parts -= IN_ARTICLE
    if tag in ROOTS or not parts:
        return ""
    return "comments" if parts & COMMENTS else "part"


class _Tags:
    """Finds the tags of a page one after another; no character is looked at more than a few times."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.none: set[str] = set()  # what does not come up any more

    def after(self, what: str, at: int) -> int:
        """Where the next `what` ends, or the end of the page."""
        found = -1 if what in self.none else self.page.find(what, at)
        if found < 0:
            self.none.add(what)
            return len(self.page)
        return found + len(what)

    def attributes(self, at: int) -> tuple[str, int]:
        """The attributes that begin at `at`, and where the tag ends: after its `>`, or before the next `<`."""
        page, k = self.page, at
        while True:
            k = PLAIN.match(page, k).end()
            if k == len(page) or page[k] == "<":
                return page[at:k], k
            if page[k] == ">":
                return page[at:k], k + 1
            k = k + 1 if page[k] in self.none else self._closed(k)

    def _closed(self, k: int) -> int:
        end = self.page.find(self.page[k], k + 1)
        if end < 0:  # a quote that is never closed is a character like any other
            self.none.add(self.page[k])
            return k + 1
        return end + 1

    def end_of_raw(self, tag: str, at: int) -> int:
        key = f"</{tag}"
        if key in self.none:
            return len(self.page)
        found = re.compile(f"</{re.escape(tag)}(?![a-zA-Z0-9])[^<>]*>?", re.I).search(self.page, at)
        if found is None:
            self.none.add(key)
            return len(self.page)
        return found.end()


class _Parser:
    def __init__(self) -> None:
        self.paths: list[Path] = []
        self.known: dict[tuple[int, str, str, bool], int] = {}
        self.open: list[tuple[str, int, bool]] = []  # tag, path (-1 if skipped) and whether it is skipped
        self.count: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.pieces: list[str] = []
        self.linked = self.links = 0

    def add(self, text: str) -> None:
        if text and not (self.open and self.open[-1][2]):
            self.pieces.append(text)
            if self.links:
                self.linked += len(text.strip())

    def close_block(self) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                self.blocks.append(Block(self.open[-1][1] if self.open else self.node(-1, "", {}), text, min(self.linked, len(text))))
            self.pieces.clear()
        self.linked = self.links = 0

    def node(self, parent: int, tag: str, own: dict[str, str]) -> int:
        article = tag in ARTICLES or parent >= 0 and self.paths[parent].article
        named = _named(tag, own, parent >= 0 and self.paths[parent].article) if own or tag == "form" else ""
        first = own.get("class", "").split()[:1]
        key = (parent, f"{tag}.{first[0]}" if first else tag, named, article)
        if key not in self.known:
            above = self.paths[parent].named if parent >= 0 else ""
            self.known[key] = len(self.paths)
            self.paths.append(Path(parent, tag, article, "comments" if "comments" in (above, named) else above or named))
        return self.known[key]

    def push(self, tag: str, attributes: str) -> None:
        own = {m[1].lower(): m[2].strip("\"'") if m[2] else "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        parent, above = (self.open[-1][1], self.open[-1][2]) if self.open else (-1, False)
        skipped = above or tag in NEVER or "hidden" in own or tag == "header" and not (parent >= 0 and self.paths[parent].article)
        self.open.append((tag, -1 if skipped else self.node(parent, tag, own), skipped))
        self.count[tag] += 1

    def pop(self) -> str:
        tag = self.open.pop()[0]
        self.count[tag] -= 1
        return tag

    def start(self, tag: str, attributes: str) -> None:
        """A block element begins: a paragraph ends, and so does a list item or table cell before its sibling."""
        self.close_block()
        ends = SIBLINGS.get(tag)
        while self.open and (self.open[-1][0] == "p" or ends and SIBLINGS.get(self.open[-1][0]) == ends):
            self.pop()
        self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if not self.count[tag]:
            return
        self.close_block()
        while self.pop() != tag:
            pass


def parse(page: str) -> Page:
    """The text blocks of a page in order, and the tree of their tag paths."""
    tags, parser, at = _Tags(page), _Parser(), 0
    while True:
        lt = page.find("<", at)
        if lt < 0:
            parser.add(page[at:])
            break
        parser.add(page[at:lt])
        name = NAME.match(page, lt + 1)
        if name is None:
            if page.startswith("<!--", lt):
                at = tags.after("-->", lt + 4)
            elif page.startswith(("<!", "<?"), lt):
                at = tags.after(">", lt)
            else:
                parser.add("<")
                at = lt + 1
            continue
        attributes, at = tags.attributes(name.end())
        tag = name[2].lower()
        if tag in INLINE:
            if tag == "a":
                parser.links = 0 if name[1] else 1
        elif name[1]:
            parser.end(tag)
        elif tag in VOID:
            if tag == "br":
                parser.add(" ")
            elif tag == "hr":
                parser.close_block()
        elif tag in RAW:
            parser.close_block()
            at = tags.end_of_raw(tag, at)
        elif attributes.endswith("/"):
            parser.close_block()
        else:
            parser.start(tag, attributes)
    parser.close_block()
    return Page(parser.paths, parser.blocks)


def _smoothed(values: np.ndarray) -> np.ndarray:
    edge = len(SMOOTHING) // 2
    return np.convolve(np.pad(values, edge, mode="edge"), SMOOTHING, mode="valid")


def _weights(paths: list[Path], unlinked: np.ndarray) -> np.ndarray:
    """What the names of parts leave of each path's score: NAMED or 1. `unlinked` is the text outside links by path."""
    below, half = unlinked.tolist(), unlinked.sum() / 2
    holds = [p.tag in ARTICLES or p.tag == "h1" for p in paths]
    marked = any(holds)
    for k in range(len(paths) - 1, 0, -1):  # parents come before their children
        if (up := paths[k].parent) >= 0:
            below[up] += below[k]
            holds[up] |= holds[k]
    free = [False] * len(paths)  # beneath a part that its name does not speak against
    weights = np.ones(len(paths))
    for k, path in enumerate(paths):
        most = below[k] > half and (holds[k] or not marked)
        free[k] = path.parent >= 0 and free[path.parent] or path.named == "part" and most
        if path.named == "comments" or path.named and not free[k]:
            weights[k] = NAMED
    return weights


class Scores(NamedTuple):
    """By path: the mean of its blocks' scores, what its name leaves of it, its text and linked text; and the spread of all scores."""

    score: np.ndarray
    weight: np.ndarray
    length: np.ndarray
    linked: np.ndarray
    spread: float


def scored(page: Page) -> Scores:
    path = np.array([b.path for b in page.blocks])
    total = lambda values: np.bincount(path, weights=values, minlength=len(page.paths))
    n = np.bincount(path, minlength=len(page.paths))
    length, linked = total([len(b.text) for b in page.blocks]), total([b.linked for b in page.blocks])
    marks = total([len(MARKS.findall(b.text)) for b in page.blocks])
    each, text = np.maximum(n, 1), np.maximum(length, 1)
    weight = _weights(page.paths, length - linked)
    fused = _smoothed((length / each)[path]) * _smoothed(((marks + 0.1) / each)[path])
    fused = fused * ((1 - linked / text) * weight)[path]
    return Scores(total(fused) / each, weight, length, linked, float(np.std(fused)))


def content_paths(page: Page) -> np.ndarray:
    """Which paths are content."""
    s = scored(page)
    textual = (s.length > 0) & (2 * s.linked <= s.length)
    chosen = textual & (s.score >= THRESHOLD * s.spread)
    if not chosen.any():
        return chosen
    heavy = int(np.argmax(np.where(chosen, s.length, -1)))
    container = page.paths[heavy].parent
    if page.paths[heavy].article:
        container = heavy
        while page.paths[container].tag not in ARTICLES:
            container = page.paths[container].parent
    whole_page = container < 0 or page.paths[container].tag in ROOTS
    beneath = np.zeros(len(page.paths), bool)
    for k, path in enumerate(page.paths):
        if whole_page:
            beneath[k] = path.parent == container and path.tag in HEADINGS
        else:
            beneath[k] = k == container or path.parent >= 0 and beneath[path.parent]
    if not whole_page:
        beneath[container] = page.paths[container].article  # what stands beside the container may share its path
    return chosen | textual & beneath & (s.weight == 1)


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    found = parse(page or "")
    if not found.blocks:
        return ""
    content = content_paths(found)
    return "\n".join(block.text for block in found.blocks if content[block.path])


def extract(pages: DataFrame, text_col: str = "html", carried: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The carried columns and text, the main text of each page."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carried) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, len(carried)):
            texts = [main_text(page.as_py()) for page in block.column(len(carried))]
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(texts, pa.string())], names=[*carried, "text"])

    return pages.select(*carried, F.col(text_col).cast("string").alias("__page")).mapInArrow(run, schema)
