"""Taking tags and character references out of text."""

from __future__ import annotations

import functools
import html
import html.entities
import re
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.plans.dialect import SPARK, rewritten

#: The common references; the ampersand comes last, or it would make new ones.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#0*39;|&apos;|&#x27;", "'"),
    ("&nbsp;|&#0*160;", " "),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&middot;", "·"),
    ("&hellip;", "…"),
    ("&mdash;|&#8212;", "—"),
    ("&ndash;|&#8211;", "–"),
    ("&lsquo;|&#8216;", "‘"),
    ("&rsquo;|&#8217;", "’"),
    ("&ldquo;|&#8220;", "“"),
    ("&rdquo;|&#8221;", "”"),
    ("&amp;|&#0*38;", "&"),
)
_TAG = r"(?s)<!--.*?-->|<[!?/]?[a-zA-Z][^>]*>"


def strip_tags(text: Any, on: Any = SPARK) -> Any:
    """Without well-formed tags and comments. The text of scripts and styles stays, as do references."""
    return on.replace(text, _TAG, "")


@functools.lru_cache(1)
def _references() -> str:
    """A SQL function that resolves all references that end in a semicolon, by the table of names that Python comes with.

    Names and what they stand for are two texts, which are cut up once for a plan.
    """
    known = sorted((name[:-1], char) for name, char in html.entities.html5.items() if name.endswith(";"))
    quoted = lambda t: "'" + "".join("\\" + c if c in "\\'" else c for c in t) + "'"
    names, chars = (f"split({quoted(chr(1).join(column))}, '\\u0001')" for column in zip(*known, strict=True))
    # numbers that old pages mean as those of another character set
    by_number = ", ".join(f"{n}L, {quoted(bytes([n]).decode('cp1252', 'replace'))}" for n in range(0x80, 0xA0) if bytes([n]).decode("cp1252", "ignore"))
    number = "CAST(CASE WHEN r[0] = 'x' THEN conv(substring(r, 2), 16, 10) ELSE r END AS BIGINT)"
    valid = "n > 0 AND n < 1114112 AND (n < 55296 OR n > 57343)"
    of_number = f"transform(array({number}), n -> coalesce(try_element_at(map({by_number}), n), CASE WHEN {valid} THEN decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') ELSE '\ufffd' END))[0]".replace("r[0] = 'x'", "startswith(r, 'x')")
    named = f"try_element_at({chars}, CAST(nullif(array_position({names}, regexp_extract(p, '^&([A-Za-z][A-Za-z0-9]*);', 1)), 0) AS INT))"
    found = f"CASE WHEN p RLIKE '^&#([0-9]{{1,9}}|[xX][0-9A-Fa-f]{{1,8}});' THEN transform(array(lower(regexp_extract(p, '^&#([^;]+);', 1))), r -> {of_number})[0] ELSE {named} END"
    piece = f"p -> transform(array({found}), c -> CASE WHEN c IS NULL THEN p ELSE concat(c, substring(p, instr(p, ';') + 1)) END)[0]"
    return f"x -> CASE WHEN contains(x, '&') THEN array_join(transform(split(x, '(?=&)'), {piece}), '') ELSE x END"


def unescape_common(text: Any, on: Any = SPARK) -> Any:
    """With the common character references resolved, in every dialect alike. Names that merely begin with one stay."""
    return rewritten(text, [(f"(?:{name})", char) for name, char in ENTITIES], on)


def unescape(text: Any, on: Any = SPARK) -> Any:
    """With character references resolved: all that end in a semicolon as a Column, the common ones in other dialects."""
    if on is SPARK:
        return F.call_function("transform", F.array(text), F.expr(_references()))[0]
    return unescape_common(text, on)



#: What a browser takes for markup: comments, declarations, and tags, whose quoted values may hold anything.
MARKUP = r"(?s)<!--.*?-->|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>|<[!?][^>]*>"
#: What begins as a character reference does, perhaps without the semicolon at its end.
REFERENCE = "&([a-zA-Z0-9#]+);?"


_MARKUP, _REFERENCE = re.compile(MARKUP), re.compile(REFERENCE)


def without_tags(value: str) -> str:
    """Markup taken out, and again as long as that puts new markup together.

    The text of scripts and styles stays, as does what is no markup: "a < b > c", or a tag that never ends.
    References are not resolved, only closed by a semicolon.
    """
    before = None
    while before != value:
        before, value = value, _MARKUP.sub("", value)
    return _REFERENCE.sub(r"&\1;", value)


@F.pandas_udf(T.StringType())
def strip_tags_exact(texts: pd.Series) -> pd.Series:
    """strip_tags() for broken markup as well; see without_tags()."""
    return texts.map(lambda t: None if t is None else without_tags(t))


@F.pandas_udf(T.StringType())
def unescape_exact(texts: pd.Series) -> pd.Series:
    """unescape() for all character references."""
    return texts.map(lambda t: None if t is None else html.unescape(t))
