"""What a page's linked data says of its article: title, authors, image and dates, by VARIANT values.

Every script of linked data is parsed by itself, and one that is broken is as none. Lists and graphs,
within each other too, are opened into their items; the item that is an article tells, or else the page.
What it names by identity only is looked up among the others. All of it is SQL functions over a page,
without a join or an explosion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions import text
from broadsheet.plans.dialect import SPARK, Form

# ---- fixed values: where linked data stands, and the names that it goes by ----
_SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']?application/ld\+json[^>]*>(.*?)</script"
_WRAPPED = r"(?s)^\s*(?://)?\s*(?:<!--|<!\[CDATA\[)?(.*?)(?:(?://)?\s*(?:-->|\]\]>))?[;\s]*$"
_ARTICLE, _PAGE = r"(?i)(?:Article|Posting|Report|Review|Recipe)$", r"(?i)(?:^|[/:])\w*(?:WebPage|VideoObject)$"
_TITLES, _PUBLISHED, _MODIFIED = ("headline", "name"), ("datePublished", "dateCreated", "uploadDate"), ("dateModified",)
_INSIDE = ("@graph", "mainEntity", "mainEntityOfPage", "itemListElement", "item")
# ---- end of fixed values ----
#: Levels of lists and graphs within each other that are opened.
DEPTH = 3
_LISTED = Form("i -> CASE WHEN i IS NULL THEN CAST(array() AS ARRAY<VARIANT>) WHEN startswith(schema_of_variant(i), 'ARRAY') THEN coalesce(try_variant_get(i, '$', 'array<variant>'), CAST(array() AS ARRAY<VARIANT>)) ELSE array(i) END")
FIELDS = "struct<title:string,authors:array<string>,image:string,published:string,modified:string,type:string>"


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(x), body)[0]


def _at(item: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(item, f'$["{name}"]', kind)


def _kind(item: Column) -> Column:
    return F.schema_of_variant(item)


def _listed(item: Column) -> Column:
    """The items of a list, or a single item as one; none for null."""
    return SPARK.form(item, _LISTED)


def _is_object(item: Column) -> Column:
    return F.coalesce(F.startswith(_kind(item), F.lit("OBJECT")), F.lit(False))


def items(page: Column) -> Column:
    """All items of linked data of a page, as an array of VARIANT, those that hold others before these."""
    scripts = F.regexp_extract_all(page, F.lit(_SCRIPT), 1)
    parsed = F.transform(scripts, lambda s: F.try_parse_json(F.regexp_extract(s, _WRAPPED, 1)))
    found = F.filter(F.flatten(F.transform(parsed, _listed)), _is_object)

    def opened(have: Column, levels: int) -> Column:
        """`have`, and what its items hold, and so on."""
        inner = F.flatten(F.transform(have, lambda i: F.flatten(F.array(*(_listed(_at(i, name)) for name in _INSIDE)))))
        below = F.filter(inner, _is_object)
        return F.concat(have, _let(below, lambda b: opened(b, levels - 1)) if levels > 1 else below)

    return F.when(F.size(scripts) > 0, _let(found, lambda have: opened(have, DEPTH)))


def _types(item: Column) -> Column:
    return F.transform(_listed(_at(item, "@type")), lambda t: F.try_variant_get(t, "$", "string"))


def _of_type(found: Column, pattern: str) -> Column:
    return F.filter(found, lambda i: F.exists(_types(i), lambda t: t.rlike(pattern)))


def _said(item: Column, names: tuple[str, ...]) -> Column:
    """The first of some properties that is a text with anything in it."""
    return F.coalesce(*(F.nullif(F.trim(F.when(~_is_object(_at(item, n)), _at(item, n, "string"))), F.lit("")) for n in names))


def _named(found: Column, value: Column, names: tuple[str, ...]) -> Column:
    """A text, or the named property of an object; of one that is nothing but an identity, that of the item which has it."""

    def of(v: Column) -> Column:
        identity = _at(v, "@id", "string")
        same = lambda i: (_at(i, "@id", "string") == identity) & _said(i, names).isNotNull()
        there = F.get(F.filter(found, same), F.lit(0))
        return F.when(_is_object(v), F.coalesce(_said(v, names), F.when(identity.isNotNull(), _said(there, names)))).otherwise(F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")))

    return _let(value, of)


def article(page: Column) -> Column:
    """title, authors, image, published, modified and type of a page's article, as a struct; null without one.

    Of several articles the first in the page counts. Dates are as they stand. Texts have their character
    references resolved. Nulls, broken scripts and items without a type are as none.
    """
    plain = lambda t: text.unescape(t)

    def told(x: Column) -> Column:
        found, item = x["found"], x["item"]
        authors = F.array_distinct(F.filter(F.transform(_listed(_at(item, "author")), lambda a: _named(found, a, ("name",))), lambda n: n.isNotNull()))
        images = F.filter(F.transform(_listed(F.coalesce(_at(item, "image"), _at(item, "thumbnailUrl"))), lambda i: _named(found, i, ("url", "contentUrl"))), lambda u: u.isNotNull())
        fields = {
            "title": plain(_said(item, _TITLES)),
            "authors": F.when(F.size(authors) > 0, F.transform(authors, plain)),
            "image": F.get(images, F.lit(0)),
            "published": _said(item, _PUBLISHED),
            "modified": _said(item, _MODIFIED),
            "type": F.get(_types(item), F.lit(0)),
        }
        return F.when(item.isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())))

    def chosen(found: Column) -> Column:
        item = F.coalesce(F.get(_of_type(found, _ARTICLE), F.lit(0)), F.get(_of_type(found, _PAGE), F.lit(0)))
        return _let(F.struct(found.alias("found"), item.alias("item")), told)

    return F.when(F.contains(F.lower(page), F.lit("ld+json")), _let(items(page), chosen)).cast(FIELDS)
