"""The main text of a page: a chain of extractors, the first of which that finds anything decides.

A page is parsed once. All extractors are tried in turn inside one UDF, as separate UDFs would all
be run. If what one found is too short the page is too short, and no other is asked.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.plans.dialect import SPARK, found

#: A text must have more characters than this before it is stripped.
LEAST = 200
MAIN_ELEMENT, SCORED, BLOCK_CLASSIFIER, SENTENCES, PARAGRAPHS, RAW_TEXT, BARE, FAILED = "main_element", "scored_container", "block_classifier", "sentences", "paragraphs", "raw_text", "bare_text", "failed"
OK, TOO_SHORT = "ok", "too_short"
#: Direct parents whose text the raw extractor leaves out, and what a given text's method is called.
RAW_SKIPPED = frozenset(["[document]", "noscript", "header", "html", "meta", "head", "input", "script", "style"])
GIVEN = "overriden"
IMAGE = r"!\[[^\]]*\]\((.*?)\)"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("script style noscript template head title nav footer aside form button select".split())
_BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())


@dataclass
class Block:
    """A stretch of text between block tags, and the numbers of the elements it lies in, from the outermost."""

    tag: str
    inside: tuple[int, ...] = ()
    text: list[str] = field(default_factory=list)
    linked: int = 0

    def words(self) -> list[str]:
        return "".join(self.text).split()


class Page(HTMLParser):
    """Blocks, text with its direct parent, and what a page says of itself. With `images`, these stand in the text as markdown."""

    def __init__(self, page: str, images: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.images, self.page = images, page
        self.open: list[tuple[str, int]] = []
        self.elements = 0
        self.main: list[int] = []
        self.blocks = [Block("[document]")]
        self.raw: list[str] = []
        self.titles: dict[str, list[list[str]]] = {"h1": [], "title": []}
        self.feed(page)
        self.close()

    def _inside(self) -> tuple[int, ...]:
        return tuple(n for _, n in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        has = dict(attrs)
        if tag in _BLOCKS and (tag == "p" or tag in ("h1", "h2", "h3", "h4", "h5", "h6", "div", "ul", "ol", "table")):
            while any(t == "p" for t, _ in self.open[-8:]):
                self.open.pop()
        self.elements += 1
        if tag not in _VOID:
            self.open.append((tag, self.elements))
        if tag in self.titles:
            self.titles[tag].append([])
        if tag in ("article", "main") or (has.get("itemprop") or "").lower() == "articlebody" or (has.get("role") or "").lower() == "main":
            self.main.append(self.elements)
        if tag in _BLOCKS:
            self.blocks.append(Block(tag, self._inside()))
        elif tag == "br":
            self.handle_data("\n")
        elif tag == "img" and self.images and has.get("src"):
            self.handle_data(f" ![{(has.get('alt') or '').replace(']', ' ')}]({has['src']}) ")

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if tag in _BLOCKS:
            self.blocks.append(Block(self.open[-1][0] if self.open else "[document]", self._inside()))

    def handle_data(self, data: str) -> None:
        tags = [t for t, _ in self.open]
        if (tags[-1] if tags else "[document]") not in RAW_SKIPPED and data != "\n":
            self.raw.append(data)
        for name, parts in self.titles.items():
            if name in tags:
                parts[-1].append(data)
        if not _SKIPPED.intersection(tags):
            self.blocks[-1].text.append(data)
            if "a" in tags:
                self.blocks[-1].linked += len(data.split())

    def filled(self) -> list[tuple[Block, list[str]]]:
        """The blocks that have words, with these."""
        return [(b, w) for b in self.blocks if (w := b.words())]

    def title(self) -> str | None:
        """The text of the first h1 that has one, else of the title element."""
        return next((t for name in ("h1", "title") for parts in self.titles[name] if (t := " ".join("".join(parts).split()))), None)


def _text(blocks: list[tuple[Block, list[str]]]) -> str:
    return "\n".join(" ".join(w) for _, w in blocks)


def by_main_element(page: Page) -> str:
    """The blocks of the page's own article, main or articleBody elements, but for those that are mostly links."""
    main = set(page.main)
    blocks = [(b, w) for b, w in page.filled() if main.intersection(b.inside)]
    kept = [(b, w) for b, w in blocks if 2 * b.linked <= len(w)]
    return _text(kept) if 2 * sum(len(w) for _, w in kept) > sum(len(w) for _, w in blocks) else ""


def by_points(page: Page) -> str:
    """The blocks of the element to which the paragraphs right in it, and half as much those one level below, give most points."""
    points: dict[int, float] = {}
    words: dict[int, int] = {}
    linked: dict[int, int] = {}
    blocks = page.filled()
    for b, w in blocks:
        for n in b.inside:
            words[n] = words.get(n, 0) + len(w)
            linked[n] = linked.get(n, 0) + b.linked
        if b.tag in ("p", "pre", "blockquote", "td", "div", "section") and len(w) >= 5:
            text = " ".join(w)
            worth = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - b.linked / len(w))
            above = b.inside if b.tag in ("div", "section", "td") else b.inside[:-1]
            for share, n in zip((1.0, 0.5), reversed(above), strict=False):
                points[n] = points.get(n, 0.0) + share * worth
    if not points:
        return ""
    best = max(points, key=lambda n: (points[n] * (1 - linked[n] / words[n]), -n))
    return _text([(b, w) for b, w in blocks if best in b.inside and 2 * b.linked <= len(w)])


def _is_text(here: tuple[int, float], before: tuple[int, float], after: tuple[int, float]) -> bool:
    """Whether a block is content, from (words, share of linked words) of it and its neighbours."""
    if here[1] > 1 / 3:
        return False
    if before[1] > 5 / 9:
        return here[0] > 40 or after[0] > 17
    return here[0] > 16 or after[0] > 15 or before[0] > 4 and here[0] > 3


def by_blocks(page: Page) -> str:
    """The blocks that look like text."""
    filled = page.filled()
    sizes = [(0, 0.0), *((len(w), b.linked / len(w)) for b, w in filled), (0, 0.0)]
    return "\n".join(" ".join(w) for i, (_, w) in enumerate(filled) if _is_text(sizes[i + 1], sizes[i], sizes[i + 2]))


def by_sentences(page: Page) -> str:
    """The run of blocks with the most words in which all but single blocks between them end as sentences do."""
    best: list[tuple[Block, list[str]]] = []
    run: list[tuple[Block, list[str]]] = []
    missed = 0
    size = lambda r: sum(len(w) for _, w in r)
    for b, w in page.filled():
        if len(w) >= 4 and w[-1][-1] in ".!?…。\"”»)" and not b.linked * 2 > len(w):
            run.append((b, w))
            missed = 0
        elif missed:
            run, missed = [], 0
        else:
            missed = 1
        if size(run) > size(best):
            best = list(run)
    return _text(best)


def by_paragraphs(page: Page) -> str:
    """All paragraphs."""
    return "\n".join(" ".join(w) for b in page.blocks if b.tag == "p" and (w := b.words()))


def by_raw_text(page: Page) -> str:
    """Every text whose direct parent is visible, each with a space behind it."""
    return "".join(f"{t} " for t in page.raw)


_BARE = re.compile(r"(?is)<!--.*?-->|<(script|style|form|iframe|head)\b.*?(?:</\1\s*>|\Z)|<[^>]*>")


def by_bare_text(page: Page) -> str:
    """What is left of the page without scripts, styles, forms, its head, comments and tags."""
    return " ".join(_BARE.sub(" ", page.page).split())


Extractor = Callable[[Page], str]
EXTRACTORS: tuple[tuple[str, Extractor], ...] = (
    (MAIN_ELEMENT, by_main_element),
    (SCORED, by_points),
    (BLOCK_CLASSIFIER, by_blocks),
    (SENTENCES, by_sentences),
    (PARAGRAPHS, by_paragraphs),
    (RAW_TEXT, by_raw_text),
    (BARE, by_bare_text),
)
SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "method", "status", "title", "image")])


def extract_one(page: str | None, extractors: Sequence[tuple[str, Extractor]] = EXTRACTORS, with_images: bool = False) -> tuple[str | None, ...]:
    """(text, method, status, title, image) of one page; the image is the first in the text, which is then without any."""
    if page:
        parsed = Page(page, with_images)
        for name, extractor in extractors:
            text, image = extractor(parsed), None
            if with_images and (seen := re.search(IMAGE, text)):
                text, image = re.sub(IMAGE, "", text), seen[1]
            if text:
                return (text.strip(), name, OK, parsed.title(), image) if len(text) > LEAST else (None, name, TOO_SHORT, parsed.title(), image)
    return None, FAILED, FAILED, None, None


def content(page: Column, extractors: Sequence[tuple[str, Extractor]] = EXTRACTORS, with_images: bool = False) -> Column:
    """extract_one() as a struct column. A null or empty page is a failed one.

    Pages come in rows, of which a worker holds a hundred, and not in Arrow batches, which hold ten thousand.
    """

    @F.udf(SCHEMA, useArrow=False)
    def run(one: str | None) -> tuple[str | None, ...]:
        return extract_one(one, extractors, with_images)

    return run(page)


@F.udf(T.StringType(), useArrow=False)
def raw_text(page: str | None) -> str | None:
    """by_raw_text() alone."""
    return None if page is None else by_raw_text(Page(page))


def canonical_url(page, on=SPARK):
    """The canonical link, else og:url; quotes of either kind."""
    # fixed values: where pages say what they are to be called
    first = r"(?is)<link[^>]* rel=[\"']canonical[\"'][^>]* href=[\"']([^\"']+)[\"']"
    turned = r"(?is)<link[^>]* href=[\"']([^\"']+)[\"'][^>]* rel=[\"']canonical[\"']"
    other = r"(?is)<meta[^>]* property=[\"']og:url[\"'][^>]* content=[\"']([^\"']+)[\"']"
    return on.first_given(*(found(page, p.replace('\\"', '"'), 1, on) for p in (first, turned, other)))


def images(text: Column) -> Column:
    """The addresses of images written in markdown."""
    return F.regexp_extract_all(text, F.lit(IMAGE), 1)


def without_images(text: Column) -> Column:
    """The text without them."""
    return F.regexp_replace(text, IMAGE, "")


def authors(names: Column) -> Column:
    """Names parted by commas, as an array; null for none."""
    return F.split(F.nullif(names, F.lit("")), ",")


def status_of(text: Column) -> Column:
    """What a text that was found makes of its page."""
    return F.when(text.isNull(), FAILED).when(F.length(text) > LEAST, OK).otherwise(TOO_SHORT)


