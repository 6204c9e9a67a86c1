"""Main text of HTML pages by scoring the tree.

Paragraphs pass points for their length and commas to their ancestors, less the further up; the share
of an element's text that stands in links takes from its points, and so do class and id words that name
what is around articles. The element with the most points and those of its siblings that look like parts
of the same article are kept, without the smaller parts that are named as furniture.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.common import table

_NAME = r"[A-Za-z][^\s/>]*"
_ATTRIBUTES = r"(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+"
#: Comments, declarations and tags. A quote that is never closed ends with the tag.
MARKUP = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)({_NAME})({_ATTRIBUTES})>|<(/?)({_NAME})([^>]*)(?:>|\Z)|</[^A-Za-z>][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLANK = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is never article text.
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript template head nav footer aside button select option datalist dialog menu object canvas svg audio video map applet annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes, and what it does not look beyond.
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split(), ({"p"}, BLOCKS - {"p"})),
    "li": ({"li", "p"}, frozenset({"ul", "ol", "menu", "table"})),
    "dt": ({"dt", "dd", "p"}, frozenset({"dl", "table"})),
    "dd": ({"dt", "dd", "p"}, frozenset({"dl", "table"})),
    "tr": ({"tr", "td", "th", "p"}, frozenset({"table"})),
    "td": ({"td", "th", "p"}, frozenset({"table", "tr"})),
    "th": ({"td", "th", "p"}, frozenset({"table", "tr"})),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot", "p"}, frozenset({"table"})),
    "option": ({"option"}, frozenset({"select", "datalist"})),
}
#: Words of class and id that name what is never article text. Matched as whole words.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertisements advertising nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc"
    " sidebar sidebars comment comments commentlist disqus replies respond responses cookie cookies consent gdpr footer colophon".split()
)
#: Words that name what is around an article, mostly.
AROUND = frozenset(
    "advertorial banner banners sponsor sponsored sponsors promo promos promotion promoted aside rail widget widgets related recommended recommendations trending popular"
    " header masthead topbar foot bottom reply discussion notice notices alert popup modal overlay paywall newsletter subscribe subscription signup login"
    " share sharing social form search searchform copyright legal disclaimer skip".split()
)
#: Beside a word of furniture these say no more than where or how much of it there is: "ad-box" is an ad, "popular-science" is not popular.
FILLERS = frozenset(
    "area bar block blocks body box btn button buttons col column container content entry group holder icon icons inline inner item items label layer left link links list main module outer panel posts"
    " primary reader readers region right row secondary section segment slot stories thread title top unit user users visitor visitors wrap wrapper zone".split()
)
#: Names that articles' own parts have; such an element is scored, whatever other names it has.
WITHIN = frozenset("article content main body story post entry headline".split())
#: Of AROUND, what articles' own parts are named by as well.
WEAK = frozenset("header form social search skip bottom copyright legal notice notices discussion popular subscribe related share sharing".split())
#: Beside these, a word says what an element does or doesn't stand next to.
BESIDE = frozenset("with has no without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Headings of what readers wrote, those that say how many there are, and those that may also be an article's own.
COUNTED = re.compile(r"(?:\d+ (?:reader |user )?(?:comments?|responses?|replies|reply)|(?:reader |user )?(?:comments?|responses|replies) ?[(\[:]? ?\d+ ?[)\]]?)(?: (?:to|on) .*)?", re.I)
SAID = re.compile(r"(?:(?:reader|user)s?'? )?(?:comments|responses|replies)|(?:leave|post|add) a (?:comment|reply)|join the (?:discussion|conversation)", re.I)
#: What short texts beside an article say that are no part of it.
NOTICE = re.compile(r"©|\(c\) ?\d{4}|\bcopyright\b|all rights reserved|\bcookies?\b|\b(?:sign|log) (?:up|in)\b|\bsubscribe\b|\bnewsletter\b|\badvert", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """An element; children are nodes and strings in order of the page."""

    __slots__ = ("attributes", "children", "goes", "name", "parent", "points", "sizes", "weight")

    def __init__(self, name: str, attributes: str, parent: Node | None) -> None:
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Node | str] = []
        self.points = 0.0
        self.weight = 1.0  # what its names, and those of the elements around it, leave of its points
        self.goes = False  # whether it is left out of an article of which it is the smaller part
        self.sizes = (0, 0)  # code points of its text, and of that in links, without parts that go


def parse(page: str) -> Node:
    """The tree of a page. Unclosed elements end as HTML lets them end; stray end tags do nothing."""
    root = here = Node("#root", "", None)
    at, end = 0, len(page)
    stack = [root]
    places: dict[str, list[int]] = {}  # where in the stack open elements of a name are, so that no search walks up the tree

    def close(place: int) -> Node:
        """Ends all elements from a place of the stack on; the one around them."""
        while len(stack) > place:
            places[stack.pop().name].pop()
        return stack[-1]

    def last(names: Iterable[str]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    while at < end:
        m = MARKUP.search(page, at)
        if not m:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if places.get(name):
                here = close(places[name][-1])
            elif name == "br":
                here.children.append(Node("br", "", here))
            continue
        if name in CLOSES:
            shut, wall = CLOSES[name]
            while (place := last(shut)) and place > last(wall):
                here = close(place)
        elif name == "body" and places.get("head"):
            here = close(places["head"][-1])
        node = Node(name, attributes, here)
        here.children.append(node)
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            node.children.append(page[at : stop.start()] if stop else page[at:])
            at = page.find(">", stop.end()) + 1 if stop else end
            at = at or end
        elif name not in VOID:
            here = node
            places.setdefault(name, []).append(len(stack))
            stack.append(node)
    return root


def marks(node: Node) -> dict[str, str]:
    """Its attributes by lower-cased name; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(node.attributes):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def wrapping(root: Node) -> set[int]:
    """The forms that stand around an article, as some servers put one around every page: by id().

    They hold a main element or an article, or most of what the page has in long paragraphs.
    """
    order = list(nodes(root))
    if not any(n.name == "form" for n in order):
        return set()
    prose, holds = {}, {}
    for n in reversed(order):
        inner = [c for c in n.children if not isinstance(c, str)]
        text = own_text(n).strip() if n.name in BLOCKS and n.name not in DROPPED else ""
        prose[id(n)] = 0 if n.name in DROPPED else sum(prose[id(c)] for c in inner) + (len(text) if len(text) >= 80 else 0)
        holds[id(n)] = n.name not in DROPPED and any(c.name in ("article", "main") or holds[id(c)] for c in inner)
    whole = prose[id(root)]
    return {id(n) for n in order if n.name == "form" and (holds[id(n)] or prose[id(n)] >= max(LEAST, whole / 2))}


def is_never(node: Node, within: bool, wraps: set[int]) -> bool:
    """Whether an element is furniture by its tag, by being hidden or by its role; `within` an article its header is a headline's."""
    if node.name in DROPPED:
        return True
    if node.name == "header":
        return not within
    if node.name == "form":
        return id(node) not in wraps
    if node.name == "label" and ("for" in marks(node) or any(c.name in ("input", "select", "textarea") for c in node.children if not isinstance(c, str))):
        return True
    if not node.attributes or node.name in ("html", "body", "main", "a"):
        return False
    has = marks(node)
    if "hidden" in has or has.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", has.get("style", ""), re.I):
        return True
    return has.get("role", "").lower() in ROLES


def named(node: Node) -> tuple[float, bool, bool]:
    """What its class and id leave of an element's points, whether it goes where it is the smaller part, and whether it is dropped outright.

    A name that is nothing but furniture drops an element or takes most of its points; one that has other
    words too, as "popular-science" or "bottom-line", takes little and drops nothing. Articles, and elements
    that are also named by words of articles, are left to the points.
    """
    if not node.attributes or node.name in ("html", "body", "main", "a"):
        return 1.0, False, False
    has = marks(node)
    names = [[w.lower() for w in WORD.findall(name)] for name in re.split(r"\s+|--", f"{has.get('class', '')} {has.get('id', '')}")]
    words = {w for name in names for w in name}
    found = words & (AROUND | NEVER)
    if not found or words & BESIDE or words & WITHIN and found <= WEAK:
        return 1.0, False, False
    if node.name == "article" or words & WITHIN:
        # "post-content" is content, "post-comments" are comments, "comment-body" is one's; what stands after "--" is a variant
        part = not {name[-1] for name in names if name} & WITHIN or any(name[0] in NEVER and len(name) > 1 for name in names if name)
        return 0.75, part and node.name != "article", False
    pure = [set(name) for name in names if set(name) & found and all(w in found or w in FILLERS or len(w) < 3 for w in name)]
    if any(name & NEVER for name in pure):
        return 0.0, True, True
    if pure:
        return 0.1, True, False
    return (0.5, True, False) if words & NEVER else (0.8, False, False)


def prune(root: Node) -> None:
    """Takes away furniture, weighs what may be some, and measures the text and link text of what stays."""
    order, stack, wraps = [], [(root, False)], wrapping(root)
    while stack:
        node, within = stack.pop()
        order.append(node)
        within = within or node.name in ("article", "main")
        kept: list[Node | str] = []
        below = ""  # the heading of readers' comments that this is below
        for c, then in zip(node.children, said_next(node.children), strict=True):
            if not isinstance(c, str):
                if c.name in HEADINGS and not (below and c.name > below):
                    below = c.name if heads_comments(c, then) else ""
                if below or is_never(c, within, wraps):
                    continue
                weight, c.goes, dropped = named(c)
                if dropped:
                    continue
                c.weight = node.weight * weight
                stack.append((c, within))
            elif below:
                continue
            kept.append(c)
        node.children = kept
    for node in reversed(order):
        text = linked = 0
        for c in node.children:
            if isinstance(c, str):
                text += len(c.strip())
            elif not c.goes:
                text += c.sizes[0]
                linked += c.sizes[1]
        node.sizes = (text, text if node.name == "a" else linked)


def said_next(children: list[Node | str]) -> list[Node | None]:
    """For each child the next element after it."""
    out: list[Node | None] = []
    after = None
    for c in reversed(children):
        out.append(after)
        after = after if isinstance(c, str) else c
    return out[::-1]


def heads_comments(heading: Node, then: Node | None) -> bool:
    """Whether a heading is that of readers' comments: it counts them, or a list, a form or furniture follows it."""
    text = BLANK.sub(" ", own_text(heading)).strip()
    if COUNTED.fullmatch(text):
        return True
    return bool(SAID.fullmatch(text)) and then is not None and (then.name in ("ul", "ol", "form", "dl") or named(then)[1])


def density(node: Node) -> float:
    """The share of an element's text that stands in links."""
    return node.sizes[1] / node.sizes[0] if node.sizes[0] else 0.0


def nodes(root: Node) -> Iterator[Node]:
    """All elements below, in the order of the page."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))


def own_text(node: Node) -> str:
    """The text of an element but for blocks inside it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.name not in BLOCKS:
            stack.extend(reversed(c.children))
    return "".join(out)


#: What an element's tag makes of its points.
TAGS = {"article": 2.0, "main": 1.5, "html": 0.5, "#root": 0.4, "body": 0.8}
#: A part of an article has at least this share of the best one's points or text, and less of its text in links.
LIKE, LINKED = 0.2, 0.3
#: What is named as furniture alone is an article only with so much text.
LEAST = 200
#: Elements that list or show something, and the end of a sentence.
LISTS = frozenset("ul ol dl table figure pre blockquote".split())
SENTENCE = re.compile(r"[.!?。！？][\"'”’)]*\s*\Z")


def _alike(nodes_: list[Node], best_: Node) -> list[Node]:
    """Of article elements those that are parts of one article with the best."""
    return [n for n in nodes_ if n is best_ or not n.goes and n.weight >= best_.weight and density(n) < LINKED and n.sizes[0] >= LIKE * best_.sizes[0]]


def best(root: Node) -> list[Node]:
    """The container with the most points and its kept siblings, in the order of the page."""
    scored: list[Node] = []
    for node in nodes(root):
        if node.name not in BLOCKS or not node.sizes[0]:
            continue
        text = own_text(node).strip()
        if not text or node.name in HEADINGS:
            continue
        points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - density(node))
        up, share, level = node.parent if node.name not in ("div", "section", "article", "main", "td", "body") else node, 1.0, 0
        inner = node
        while up and level < 5 and not (inner.goes and inner is not up):  # what goes tells nothing of what is around it
            if not up.points:
                scored.append(up)
            up.points += points * share
            level += 1
            share = 1 / (level + 1)
            inner, up = up, up.parent
    if not scored:
        return [root] if root.sizes[0] else []
    for node in scored:
        node.points *= (1 - density(node)) * TAGS.get(node.name, 1.0) * node.weight
    top = max(scored, key=lambda n: n.points)
    if top.weight <= 0.1 and top.sizes[0] < LEAST:
        return []
    # a page's own article or main element that holds the winner, or that the winner holds alone, is the whole of it
    inside = top
    while inside and inside.name not in ("article", "main"):
        inside = inside.parent
    if inside:
        if inside.name == "main" or not inside.parent:
            return [inside]
        return _alike([c for c in inside.parent.children if not isinstance(c, str) and c.name == "article"], inside)
    outer = _outermost(top)
    if outer and sum(a.sizes[0] for a in outer) >= 0.3 * top.sizes[0]:
        return _alike(outer, max(outer, key=lambda a: a.points or a.sizes[0] / 100))
    # what holds nothing else is no more than a wrapper of it
    while (up := top.parent) and up.name in ("div", "section", "form", "td") and up.sizes[0] == top.sizes[0] and up.weight == top.weight:
        up.points = max(up.points, top.points)
        top = up
    if not top.parent:
        return [top]
    kept = []
    for c in top.parent.children:
        if isinstance(c, str) or c.goes and c is not top:
            continue
        text, linked = c.sizes[0], density(c)
        as_good = c.points >= LIKE * top.points and linked < LINKED and text >= 80
        sentence = c.name in ("p", "blockquote", "pre") and (text > 80 and linked < 0.25 or text and not linked and SENTENCE.search(own_text(c)))
        if c is top or as_good or c.name in HEADINGS and linked < 0.5 or sentence or c.weight >= top.weight and is_part(c):
            kept.append(c)
    return kept


def is_part(node: Node) -> bool:
    """Whether a block beside an article that no name speaks against is a part of it: a list, table or figure without many links, or one with a sentence."""
    if not node.sizes[0] or node.name not in BLOCKS or density(node) >= LINKED:
        return False
    texts = [own_text(n) for n in nodes(node) if n.name in BLOCKS and not n.goes]
    if node.sizes[0] < LEAST and any(NOTICE.search(t) for t in texts):
        return False
    return node.name in LISTS or any(n.name in LISTS for n in nodes(node)) or any(SENTENCE.search(t) for t in texts)


def _outermost(top: Node) -> list[Node]:
    """The articles and main elements below that no other holds."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        if node is not top and node.name in ("article", "main") and node.sizes[0]:
            out.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return out


def is_link_list(node: Node) -> bool:
    """A list or table of links, as menus are where their names don't tell."""
    return node.name in ("ul", "ol", "dl", "table", "div", "section") and density(node) > 0.6 and node.sizes[0] > 0


def blocks(kept: list[Node]) -> list[str]:
    """The text of each block, in the order of the page. Lists of links go only where the container is the page itself."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = BLANK.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    for top in kept:
        page = top.name in ("body", "html", "#root")
        stack: list[Node | str | None] = [top]
        while stack:
            c = stack.pop()
            if c is None:
                end()
            elif isinstance(c, str):
                line.append(c)
            elif c.name == "br":
                line.append(" ")
            elif c is not top and (page and is_link_list(c) or c.goes and c.sizes[0] <= top.sizes[0]):
                end()
            else:
                block = c.name in BLOCKS
                if block:
                    end()
                    stack.append(None)
                stack.extend(reversed(c.children))
        end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, one block a line; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n".join(blocks(best(root)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: its id, url, text and n_chars.

    Pages without article text, empty and null ones have an empty text. Text without any markup is one
    block. Other columns are not read; repeated rows and null ids come back as they are.
    """
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("html_"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(read, T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract() over the whole pages table."""
    return extract(table(spark, sf_dir, "pages"))


#: What the tables' pages mark as their article, read off that mark: the operator goes by points, and does without it.
OP10_SQL = r"""
WITH blocks AS (
  SELECT page_id, url, row_number() OVER () AS line, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages
), cleaned AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda b: trim(regexp_replace(
           regexp_replace(regexp_replace(regexp_replace(replace(b, '<br>', ' '), '</?b>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda b: b <> '') AS parts
  FROM blocks
), joined AS (
  SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text FROM cleaned
)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""
