"""Titles of pages, and the form under which titles compare equal."""

from __future__ import annotations

from typing import Any

from broadsheet.functions.text import strip_tags, unescape
from broadsheet.plans.dialect import SPARK, found, squeezed, stripped

#: A title or part of one with fewer characters is short.
SHORT = 20
#: Characters of a normal form.
LONGEST = 1024
# ---- fixed values: names that meta titles go by, and where titles stand ----
META_NAMES = "og:title|hdl|twitter:title|dc.title|dcterms.title|title"

_META = r"(?is)<meta[^>]*(?:name|property)=.(?:{names}).[^>]* content={q}([^{q}]+){q}"
_TITLE = "(?is)<title(?: [^>]*)?>(.*?)</title>"
_H1 = "(?is)<h1(?: [^>]*)?>(.*?)</h1>"
# ---- end of fixed values ----
_NOT_WORD = r"[^\p{L}\p{N}_]"
_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def _short(x: Any, on: Any) -> Any:
    return on.first_given(on.less(on.length(x), on.lit(SHORT)), on.lit(True))


def meta_title(page: Any, on: Any = SPARK) -> Any:
    """The title in a meta tag whose name stands before its content; one in single quotes if the other is missing or short."""
    by = lambda quote: found(page, _META.format(names=META_NAMES, q=quote), 1, on)
    return on.let(by('"'), lambda t: on.case((_short(t, on), by("'")), other=t))


def title_tag(page: Any, on: Any = SPARK) -> Any:
    """The stripped text of the first title element."""
    return stripped(found(page, _TITLE, 1, on), on)


def h1(page: Any, on: Any = SPARK) -> Any:
    """The text of the first h1 without its tags; null without one."""
    return stripped(unescape(strip_tags(found(page, _H1, 1, on), on), on), on)


def cleaned(title: Any, on: Any = SPARK) -> Any:
    """Without tags, references, surplus white space and a leading 'home'."""
    title = squeezed(stripped(unescape(strip_tags(title, on), on), on), on)
    return on.replace(title, rf"(?i)^{_NOT_WORD}+home{_NOT_WORD}+", "")


def comparable(title: Any, on: Any = SPARK) -> Any:
    """Without tags, what looks like URL parameters, and punctuation at either end; LONGEST characters at most."""
    title = on.replace(strip_tags(title, on), "(?i)&#?[a-z0-9]*", " ")
    title = on.replace(title, f"^{_PUNCTUATION}+|{_PUNCTUATION}+$", "")
    return stripped(on.left(squeezed(title, on), on.lit(LONGEST)), on)


def normalize_title(title: Any, on: Any = SPARK, null_as_none: bool = False) -> Any:
    """The form under which titles of one story compare equal; for a null, null or the word none."""
    normal = on.lower(comparable(title, on))
    return on.first_given(normal, on.lit("none")) if null_as_none else normal


def without_affixes(title: Any, on: Any = SPARK) -> Any:
    """Without a short prefix, or suffixes, that name the site rather than the story.

    Parts stand between ` : `, ` | ` and ` - `. A title of one part stays as it is.
    """

    def of(normal: Any) -> Any:
        def with_parts(parts: Any) -> Any:
            sizes = on.map(parts, lambda p: on.length(p))
            whole, first, last = on.length(normal), on.at(sizes, 1), on.at(sizes, -1)
            cut_last = on.left(normal, on.minus(on.minus(whole, last), on.lit(2)))
            short_first = on.less(first, on.lit(SHORT))
            two = on.case((on.both(short_first, on.less(last, on.lit(SHORT))), cut_last), (short_first, on.since(normal, on.plus(first, on.lit(3)))), other=on.at(parts, 1))

            def many(sizes: Any) -> Any:
                # up to the last long part; if that is the very last, only the first part stays
                up_to = on.let(on.last_from(sizes, SHORT), lambda k: on.case((on.same(k, on.size(sizes)), on.lit(1)), other=k))
                return on.left(normal, on.minus(whole, on.let(up_to, lambda k: on.sum_after(sizes, k, 3))))

            more = on.case((short_first, cut_last), other=on.let(sizes, many))
            n = on.size(parts)
            return on.case((on.less(n, on.lit(2)), title), (on.same(n, on.lit(2)), two), other=more)

        return on.let(on.split_on(normal, " [:|-] "), with_parts)

    return on.let(comparable(title, on), of)


def from_html(page: Any, fallback: Any = None, trim: int = 0, on: Any = SPARK) -> Any:
    """The title of a page: meta tag, title element, `fallback`; its affixes cut, or the h1 if that is in it."""
    named = on.let(meta_title(page, on), lambda t: on.case((_short(t, on), title_tag(page, on)), other=t))
    title = on.none_if(cleaned(named, on), "")
    if fallback is not None:
        title = on.first_given(title, on.none_if(fallback, ""))
    title = on.let(title, lambda t: without_affixes(t, on))
    head = h1(page, on)

    def choose(t: Any) -> Any:
        inside = lambda x: on.first_given(on.both(on.less(on.lit(SHORT), on.length(x)), on.has(stripped(t, on), x)), on.lit(False))
        nothing = on.first_given(on.same(t, on.lit("")), on.lit(True))
        return on.let(head, lambda x: on.case((on.absent(x), t), (nothing, x), (inside(x), x), other=t))

    title = on.let(title, choose)
    if trim > 0:
        title = on.left(title, on.lit(trim))
    return on.none_if(stripped(title, on), "")
