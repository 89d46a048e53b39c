"""Main text of web pages: parser events, text-to-tag ratios by block, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE = 1 << 16
BREADTH, THRESHOLD = 1.0, 0.5
# Characters a tag from which a block is text beyond doubt. A longer one counts no more, so that it doesn't raise the
# threshold over the blocks beside it.
FULL = 100.0
# Where nothing names the article, regions with less than this share of the largest one's text are teasers and the like.
SHARE = 0.1
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre script "
    "search section select style summary svg table tbody td template textarea tfoot th thead title tr ul video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Blocks that hold text and not other parts of a page.
TEXT = frozenset("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre table tbody td tfoot th thead tr ul".split())
LISTS = frozenset("li dd dt td th".split())
# Never the article's own words, whatever stands around them.
NOISE = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head iframe input label menu nav noscript object "
    "option script search select style svg template textarea title video".split()
)
# The same by the words of class, id and role. On a block of text only those count that tell what it is; words that
# name the place of a part, or what a paragraph may be about, count on parts alone.
TELLING = r"ads?|advert\w*|adsense|comments?|cookies?|consent|disqus|gdpr|newsletter|outbrain|repl(?:y|ies)|sponsor\w*|subscribe|taboola"
PLACES = (
    r"alert|banner|breadcrumbs?|complementary|contentinfo|footer|masthead|menus?|modal|nav|navbar|navigation|notices?|"
    r"pagination|popup|promo\w*|recommended|related|respond|search|share|sharing|sidebar|signup|skip|social|toolbar|widget"
)


def words(pattern: str) -> re.Pattern[str]:
    return re.compile(rf"(?:^|[\s_-])(?:{pattern})(?=$|[\s_-])")


ON_TEXT, ON_PARTS, HEADER = words(TELLING), words(f"{TELLING}|{PLACES}"), words("header")
COMMENTS = words(r"comments?|disqus|repl(?:y|ies)|respond|related|recommended")
MAIN = ("main", "article")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@dataclass
class Block:
    """A stretch of text between two block tags."""

    element: int  # the innermost block element around it
    section: int  # the outermost main or article around it, or -1
    noise: bool
    listed: bool  # an item of a list or a cell of a table
    parts: list[str]
    tags: int = 1
    linked: int = 0  # characters in links
    text: str = ""

    @property
    def link_only(self) -> bool:
        return 5 * self.linked >= 4 * len(self.text)


class Blocks(HTMLParser):
    """Blocks of a page in order, and the block elements they stand in, from parser events; linear in the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        # Of block elements: tag, the one around, the first block in it, and the block after its last.
        self.tags: list[str] = []
        self.around: list[int] = []
        self.first: list[int] = []
        self.end: list[int] = []
        self.sections: list[str] = []
        self.open: list[tuple[str, bool, int, int]] = []  # tag, noise, section, block element
        self.opened: Counter[str] = Counter()
        self.fresh = True

    def state(self) -> tuple[bool, int, int]:
        return self.open[-1][1:] if self.open else (False, -1, -1)

    def push(self, tag: str, noise: bool, section: int, element: int) -> None:
        self.open.append((tag, noise, section, element))
        self.opened[tag] += 1

    def pop(self) -> str:
        tag, _, _, element = self.open.pop()
        self.opened[tag] -= 1
        if element >= 0 and (not self.open or self.open[-1][3] != element):
            self.end[element] = len(self.blocks)
        return tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.fresh = True
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ", 1)
            return
        if tag in BLOCKS:
            while self.open and self.open[-1][0] == "p":
                self.pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.open and self.open[-1][0] == tag:
            self.pop()
        noise, section, element = self.state()
        named = {k: (v or "").lower() for k, v in attrs}
        at_top = element < 0 or self.tags[element] in ("html", "body")
        # Ids of headings, and longer ids of sections, name what stands there.
        keys = ["class", "role"] if tag in HEADINGS or tag == "section" and re.search(r"[\s_-]", named.get("id", "").strip()) else ["class", "id", "role"]
        said = " ".join(named.get(k, "") for k in keys)
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
        if tag in BLOCKS:
            element = len(self.tags)
            self.tags.append(tag)
            self.around.append(self.state()[2])
            self.first.append(len(self.blocks))
            self.end.append(1 << 60)
        if tag in MAIN:
            # An article is not part of a menu or a notice that was never closed, but comments may hold articles.
            kept_out = any(self.opened[t] for t in ("aside", "footer", "form", "#"))
            noise = kept_out or hidden or bool(COMMENTS.search(said))
            if section < 0 and not noise:
                section = len(self.sections)
                self.sections.append(tag)
        elif tag not in ("html", "body"):
            if COMMENTS.search(said) and not noise:
                self.push("#", True, section, self.state()[2])
            noise |= tag in NOISE or hidden or bool((ON_TEXT if tag in TEXT else ON_PARTS).search(said))
            # The header of a page is none of the article's; deeper down a header holds a title.
            noise |= at_top and section < 0 and (tag == "header" or bool(HEADER.search(said)))
        self.push(tag, noise, section, element)
        if not self.fresh:
            self.blocks[-1].tags += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.fresh = True
        if self.opened[tag]:
            while self.pop() != tag:
                pass
            if self.open and self.open[-1][0] == "#":
                self.pop()

    def handle_data(self, data: str, tags: int = 0) -> None:
        noise, section, element = self.state()
        if self.fresh:
            if not data.strip():
                return
            self.blocks.append(Block(element, section, noise, element >= 0 and self.tags[element] in LISTS, []))
            self.fresh = False
        block = self.blocks[-1]
        block.parts.append(data)
        block.tags += tags
        if self.opened["a"]:
            block.linked += len(" ".join(data.split()))

    def holder(self, element: int) -> int:
        """The innermost element around that is a part of the page; -1 for the page itself."""
        while element >= 0 and self.tags[element] in TEXT:
            element = self.around[element]
        return -1 if element < 0 or self.tags[element] in ("html", "body") else element

    def common(self, first: int, last: int) -> int:
        """The innermost part of the page that holds two blocks."""
        element = self.holder(self.blocks[first].element)
        while element >= 0 and self.end[element] <= last:
            element = self.holder(self.around[element])
        return element


def smoothed(x: np.ndarray, breadth: float) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * breadth)))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / breadth) ** 2)
    return np.convolve(np.pad(x, reach, mode="edge"), weights / weights.sum(), mode="valid")


def chosen(page: Blocks, breadth: float, threshold: float) -> list[int]:
    """The blocks of the article.

    A block's ratio is its text outside links by its tags, up to FULL, and 0 for noise. Blocks that have such text and
    whose smoothed ratio passes the threshold are picked. They tell the part of the page that is the article: the main
    element that they lie in, or the articles, or the innermost part around all parts that hold much picked text. Of
    that part all blocks count, short ones too, but for noise and for items of links before its first and after its
    last picked block. Where the part is the whole page, each part with much picked text counts in this way, and what
    stands in no part of its own.
    """
    blocks = page.blocks
    clean = [i for i, b in enumerate(blocks) if not b.noise]
    ratio = np.array([0.0 if b.noise else min(FULL, max(0, len(b.text) - b.linked) / b.tags) for b in blocks])
    smooth = smoothed(ratio, breadth)
    least = threshold * smooth.std()
    picked = [i for i in clean if smooth[i] >= least and not blocks[i].link_only] or clean
    for tag in MAIN:
        named = {blocks[i].section for i in picked if blocks[i].section >= 0 and page.sections[blocks[i].section] == tag}
        if named:
            ends: dict[int, list[int]] = {}
            for i in picked:
                if blocks[i].section in named:
                    ends.setdefault(blocks[i].section, [i, i])[1] = i
            return [
                i for i in clean if (b := blocks[i]).section in named
                and (not (b.listed and b.link_only) or ends[b.section][0] <= i <= ends[b.section][1])
            ]
    held: Counter[int] = Counter()
    for i in picked:
        held[page.holder(blocks[i].element)] += len(blocks[i].text)
    share = SHARE * max(held.values())
    large = {part for part, n in held.items() if n >= share}
    own = [i for i in picked if page.holder(blocks[i].element) in large]
    first, last = own[0], own[-1]
    part = page.common(first, last)
    parts = {part} if part >= 0 else large - {-1}
    inside = {i for p in parts for i in range(page.first[p], min(page.end[p], len(blocks)))}
    kept = {i for i in picked if first <= i <= last}
    if part < 0 and -1 in large:
        inside |= {i for i in clean if page.holder(blocks[i].element) < 0 and (not blocks[i].link_only or first <= i <= last)}
    return [i for i in clean if i in kept or i in inside and (not (blocks[i].listed and blocks[i].link_only) or first <= i <= last)]


def main_text(html: str, breadth: float = BREADTH, threshold: float = THRESHOLD) -> str:
    """The article's blocks, joined by one space; '' where there is no text but noise."""
    page = Blocks()
    for i in range(0, len(html), PIECE):
        page.feed(html[i:i + PIECE])
    page.close()
    for b in page.blocks:
        b.text = " ".join("".join(b.parts).split())
    if all(b.noise for b in page.blocks):
        return ""
    return " ".join(page.blocks[i].text for i in chosen(page, breadth, threshold))


def extract_pages(pages: DataFrame, breadth: float = BREADTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars. NULL html is empty; a page without an article is ''."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = [main_text(h or "", breadth, threshold) for h in x.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [x.column("page_id"), x.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
