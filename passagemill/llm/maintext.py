"""Main text of web pages: tag ratios per line, smoothed and clustered, select the content region.

The standard library's parser streams events; a line is the text of one block. The ratio of a line
is the logarithm of its characters outside links over its tags. Ratios are smoothed with a Gaussian
in page order, and a threshold found by two-means clustering splits lines into content and the rest.
Lines weigh as much as they are above it. The region is the element whose lines weigh most together,
with the parts beside it that hold paragraphs or items above the threshold, and the headings before
it; where all content lies in articles and main elements, it is their union. Its lines are the main
text, short ones included.

What is never content is left out while parsing: scripts, styles and other unseen elements, menus,
asides, page headers and footers, and elements whose role names one. Forms and elements whose class
or id names a menu, sidebar, notice, advert or comment list go after parsing, unless they are
headings, or hold most of the page's text and there is no article or main element outside. A class
or id names one if all its words do or only place it, so ``has-sidebar`` does not. Character
references are decoded, white space inside a block becomes one space, and blocks are joined by one
line feed.

Nulls: a null or empty page has the empty text. A page without markup is one block. Unclosed and
stray tags and repeated pages are fine. Very long pages take time linear in their events, and the
memory of one page. Of elements that weigh the same the innermost is taken. Added columns may not
clash: ``keep`` names the columns that stay, and those named ``text`` or ``row`` travel inside a struct.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by what they mean for a reader.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset(
    "script style noscript template head title iframe object svg math canvas audio video map "
    "select option optgroup datalist textarea button dialog".split()
)
BESIDE = frozenset("nav aside menu".split())
FORMS = frozenset(("form", "fieldset"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PAGE_ENDS = frozenset(("header", "footer"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new block of the same kind ends when they are still open.
ENDED = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
         "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert "
    "alertdialog note".split()
)
#: Words of class names and ids of what stands beside the main text.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside widget cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended comment comments respond replies disqus footer header "
    "masthead topbar toolbar pagination pager skip copyright legal disclaimer form search".split()
)
#: Words that only say where or how such an element stands.
PLACES = frozenset(
    "main site page global top bottom left right primary secondary section container wrapper box block "
    "list item items inner outer bar area link links menu post article".split()
)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")

SIGMA = 2.0


@dataclass
class Element:
    tag: str
    beside: bool
    parent: int
    named: bool = False


def names_beside(value: str) -> bool:
    """Whether one of the names in a class or id is made of words for what stands beside."""
    for token in value.split():
        words = {w.lower() for w in _NAME_WORDS.findall(token)}
        if words & NAMES and words <= NAMES | PLACES:
            return True
    return False


class Line(NamedTuple):
    text: str
    tags: int
    #: The innermost element around the block.
    at: int
    #: Characters outside links.
    plain: int


@dataclass
class Lines(HTMLParser):
    """Collects ``blocks``: parts with their elements, tags and innermost element of each block."""

    blocks: list[tuple[list[tuple[int, str]], int, int]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", False, -1)]
        self.stack = [0]
        #: Depths of the open elements of each tag, and of the open blocks.
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.open_blocks: list[int] = []
        self.beside = 0
        self.parts: list[tuple[int, str]] = []
        self.tags = 0

    def end_line(self) -> None:
        if any(text.strip() for _, text in self.parts):
            self.blocks.append((self.parts, self.tags, self.stack[-1]))
            self.tags = 0
        self.parts = []

    def lines(self) -> list[Line]:
        """The text of each block with its tags, without what is beside by name."""
        chars = [0] * len(self.elements)
        for parts, _, _ in self.blocks:
            for at, text in parts:
                chars[at] += len(text.strip())
        marked = [int(e.tag in ("article", "main")) for e in self.elements]
        for i in range(len(chars) - 1, 0, -1):  # children come after their parents
            chars[self.elements[i].parent] += chars[i]
            marked[self.elements[i].parent] += marked[i]
        gone, linked = [False] * len(chars), [False] * len(chars)
        for i, element in enumerate(self.elements[1:], 1):
            most = 2 * chars[i] > chars[0] and (marked[i] or not marked[0])
            gone[i] = gone[element.parent] or element.named and not most
            linked[i] = linked[element.parent] or element.tag == "a"
        out, before = [], 0
        for parts, tags, at in self.blocks:
            text = _SPACE.sub(" ", "".join(t for i, t in parts if not gone[i])).strip()
            before += tags
            if text:
                links = sum(len(t.strip()) for i, t in parts if linked[i] and not gone[i])
                out.append(Line(text, before, at, max(len(text) - links, 0)))
                before = 0
        return out

    def _beside(self, tag: str, attrs) -> bool:
        if tag in UNSEEN or tag in BESIDE:
            return True
        if tag in PAGE_ENDS:
            return not (self.open["article"] or self.open["main"])
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if not value:
                continue
            if name == "role" and value.lower() in ROLES:
                return True
            if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True
        return False

    @staticmethod
    def _named(tag: str, attrs) -> bool:
        if tag in HEADINGS or tag in ("html", "body", "article", "main"):
            return False
        return tag in FORMS or any(n in ("class", "id") and v and names_beside(v) for n, v in attrs)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append((self.stack[-1], " "))
        if tag in VOID:
            if tag == "hr":
                self.end_line()
            return
        if tag in BLOCKS:
            self.end_line()
            open_tag = self.elements[self.stack[-1]].tag
            if tag in ENDED.get(open_tag, ()):
                self._pop()
            elif tag == "p" and self.open_blocks:  # inline elements left open in the paragraph before
                depth = self.open_blocks[-1]
                if self.elements[self.stack[depth]].tag == "p":
                    self._pop_to(depth)
        beside = self._beside(tag, attrs)
        self.elements.append(Element(tag, beside, self.stack[-1], self._named(tag, attrs)))
        self.stack.append(len(self.elements) - 1)
        self.open[tag].append(len(self.stack) - 1)
        if tag in BLOCKS:
            self.open_blocks.append(len(self.stack) - 1)
        self.beside += beside

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _pop(self) -> None:
        element = self.elements[self.stack.pop()]
        self.beside -= element.beside
        self.open[element.tag].pop()
        if element.tag in BLOCKS:
            self.open_blocks.pop()

    def _pop_to(self, depth: int) -> None:
        """Close the element at a depth of the stack and all within."""
        while len(self.stack) > depth:
            self._pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        # An end tag of an inline element reaches no further than the block around it.
        floor = 0 if tag in BLOCKS or not self.open_blocks else self.open_blocks[-1]
        if self.open[tag] and self.open[tag][-1] > floor:
            self._pop_to(self.open[tag][-1])

    def handle_data(self, data):
        if not self.beside:
            self.parts.append((self.stack[-1], data))


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the weights of the rest count more."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    part = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return part(ratios) / part(np.ones(len(ratios)))


def threshold(values: np.ndarray) -> float:
    """The midpoint of two clusters (two-means from the extremes)."""
    low, high = values.min(), values.max()
    for _ in range(50):
        cut = (low + high) / 2
        upper = values > cut
        if not upper.any() or upper.all():
            return min(cut, values.max())
        former, (low, high) = (low, high), (values[~upper].mean(), values[upper].mean())
        if former == (low, high):
            break
    return (low + high) / 2


SECTIONING = frozenset(("article", "main", "section", "div", "body", "html", "", "td", "table"))


def line_weights(own: np.ndarray) -> np.ndarray:
    """How far lines are above the threshold between content and the rest.

    A line counts with the lesser of its own ratio and the smoothed one: long text among links and
    a link among long text are not content.
    """
    smoothed = smooth(own)
    return np.minimum(own, smoothed) - threshold(smoothed)


def content_regions(elements: list[Element], lines: list[Line]) -> set[int]:
    """Elements that hold the lines chosen by their ratios: logarithms of plain characters a tag."""
    own = np.log1p(np.array([line.plain / max(line.tags, 1) for line in lines]))
    weights = line_weights(own)
    chosen = {line.at for line, ratio in zip(lines, own >= threshold(own)) if ratio}
    nearest = [-1] * len(elements)  # article or main element around each
    for i, element in enumerate(elements):
        nearest[i] = i if element.tag in ("article", "main") else nearest[element.parent] if i else -1
    if all(nearest[at] >= 0 for at in chosen):
        regions = {nearest[at] for at in chosen}
        beside = {elements[i].parent for i in regions if elements[i].tag == "article"}
        return regions | {i for i, e in enumerate(elements) if e.tag == "article" and e.parent in beside}
    # Without such markup, the element whose lines weigh most together, the innermost of
    # equal ones, and what stands beside it and holds content of its own.
    total = [0.0] * len(elements)
    for line, weight in zip(lines, weights.tolist()):
        total[line.at] += weight
    for i in range(len(elements) - 1, 0, -1):  # children come after their parents
        total[elements[i].parent] += total[i]
    region = max((line.at for line in lines), key=total.__getitem__)
    for i, element in enumerate(elements):
        if element.tag in SECTIONING and total[i] >= total[region]:
            region = i
    # A single block is no region: take the element that holds the blocks.
    while elements[region].tag not in SECTIONING:
        region = elements[region].parent
    # The parts beside it, each the widest that does not hold the region.
    around, at = {region}, region
    while at:
        at = elements[at].parent
        around.add(at)
    regions, seen = {region}, set()
    for at in chosen:
        if elements[at].tag in SECTIONING:  # a bare line in a container is a notice or the like
            continue
        while at not in around and at not in seen:
            seen.add(at)
            if elements[at].parent in around and elements[at].parent != region:
                regions.add(at)
            at = elements[at].parent
    return regions


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.end_line()
    lines, elements = parser.lines(), parser.elements
    if not lines:
        return ""
    regions = content_regions(elements, lines)
    inside, heading = [False] * len(elements), [""] * len(elements)
    for i, element in enumerate(elements):
        inside[i] = i in regions or element.parent >= 0 and inside[element.parent]
        heading[i] = element.tag if element.tag in HEADINGS else heading[element.parent] if i else ""
    taken = [inside[line.at] for line in lines]
    first = taken.index(True)
    # The page's title, and headings right before a region.
    for i in range(len(lines) - 2, -1, -1):
        tag = heading[lines[i].at]
        taken[i] = taken[i] or bool(tag) and (taken[i + 1] or tag == "h1" and i < first)
    return "\n".join(line.text for line, own in zip(lines, taken) if own)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with the main text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], ["row", "text"])

    rows = pages.select(F.col(html).alias("html"), F.struct(*keep).alias("row"))
    return rows.mapInArrow(run, rows.select("row", F.lit("").alias("text")).schema).select("row.*", "text")
