"""Publication dates: from the URL, from meta tags, from linked data, from time elements, from the text.

A date in a copyright line is never taken. What is found later than `latest` counts as not found.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.plans.dialect import SPARK, Form

#: Days by which a date may lie ahead of the day of extraction.
AHEAD = 90
#: Names of meta tags that date a page, the most telling first.
META_NAMES = "article:published_time|datepublished|date|dc.date|dc.date.issued|dcterms.created|pubdate|publishdate|publish-date|sailthru.date|parsely-pub-date|og:published_time|article.published|cxenseparse:recs:publishtime"

_GIVEN = r"=\s*[\"']?\s*([^\"'>]{6,60})"
_META = rf"(?is)<meta[^>]*(?:name|property|itemprop)=.(?:{META_NAMES}).[^>]* content{_GIVEN}"
_META_REVERSED = rf"(?is)<meta[^>]* content{_GIVEN}[^>]*(?:name|property|itemprop)=.(?:{META_NAMES})[\"']"
_LINKED = r"(?is)\"datePublished\"\s*:\s*\"([^\"]{6,60})"
_TIME = rf"(?is)<time[^>]* datetime{_GIVEN}"
_MONTHS = "january february march april may june july august september october november december".split(" ")
_NUMBERS = "".join(m[:3] for m in _MONTHS)
_MONTH = "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in _MONTHS)
_DAY_MONTH = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)? (?:of )?({_MONTH})\.?,? ((?:19|20)\d{{2}})\b"
_MONTH_DAY = rf"(?i)\b({_MONTH})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? ((?:19|20)\d{{2}})\b"
_COPYRIGHT = r"(?is)(?:&copy;|©|\(c\)|copyright)[^<]{0,80}"


def _day(x: Column) -> Column:
    return F.try_to_timestamp(F.nullif(x, F.lit("")), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(x), body)[0]


def from_url(url: Column) -> Column:
    """A date in the path: /2021/04/30/, or /2021-4-30, or /20210430/, which takes all eight digits."""

    def parts(found: Column) -> Column:
        return F.concat_ws("-", F.substr(found, F.lit(2), F.lit(4)), *(F.lpad(F.regexp_extract(found, r"^/\d{4}[/_-]?(\d{1,2})[/_-]?(\d{1,2})", i), 2, "0") for i in (1, 2)))

    parted = F.regexp_extract(url, r"/(?:19|20)\d{2}([/_-])\d{1,2}\1\d{1,2}(?=[/_.-]|$)", 0)
    packed = F.regexp_extract(url, r"/(?:19|20)\d{6}(?=[/_.-]|$)", 0)
    of = lambda found: _let(found, lambda f: F.when(f != "", _day(parts(f))))
    return F.coalesce(of(parted), of(packed))


@functools.lru_cache(1)
def _day_form() -> Form:
    """day_of() as text, which is parsed faster than it is put together call by call."""
    parted, packed, dotted = r"^\s*((?:19|20)\d{2})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)", r"^\s*((?:19|20)\d{2})(\d{2})(\d{2})(?!\d{3})", r"^\s*(\d{1,2})[.](\d{1,2})[.]((?:19|20)\d{2})(?!\d)"
    part = lambda pattern, i: f"regexp_extract(g, r'{pattern}', {i})"
    month = lambda pattern, i: f"CAST(floor(instr('{_NUMBERS}', lower(left({part(pattern, i)}, 3))) / 3 + 1) AS STRING)"

    def by(pattern: str, year: str, month: str, day: str) -> str:
        return f"CASE WHEN g RLIKE r'{pattern}' THEN CAST(try_to_timestamp(concat_ws('-', {year}, lpad({month}, 2, '0'), lpad({day}, 2, '0')), 'yyyy-MM-dd') AS TIMESTAMP_NTZ) END"

    numbers = [by(pattern, *(part(pattern, i) for i in order)) for pattern, order in ((parted, (1, 3, 4)), (packed, (1, 2, 3)), (dotted, (3, 2, 1)))]
    named = [by(pattern, part(pattern, 3), month(pattern, m), part(pattern, d)) for pattern, d, m in ((_DAY_MONTH, 1, 2), (_MONTH_DAY, 2, 1))]
    return Form(f"g -> coalesce({', '.join(numbers + named)})")


def day_of(given: Column) -> Column:
    """The day that the value of a tag tells; null for none.

    Years first, parted by -, / or . or not at all, whatever the time behind them; days first, parted by
    dots; or with the month's English name, as mail and web servers write it. The day is the one that is
    written, in whatever zone.
    """
    return SPARK.form(given, _day_form())


def _tagged(page: Column, pattern: str) -> Column:
    """The first day that a tag of a kind tells."""
    days = F.call_function("transform", F.regexp_extract_all(page, F.lit(pattern), 1), F.expr(_day_form().spark))
    return F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))


def from_tags(page: Column, linked: Column | None = None) -> Column:
    """Meta tags, then linked data, then time elements. linked: the date that a page's linked data gives, where it has been read."""
    known = [] if linked is None else [day_of(linked)]
    return F.coalesce(_tagged(page, _META), _tagged(page, _META_REVERSED), *known, _tagged(page, _LINKED), _tagged(page, _TIME))


def _written(text: Column, pattern: str, day: int, month: int) -> Column:
    """The first date of a pattern; the text is searched once, and what was found is taken apart."""

    def day_of(found: Column) -> Column:
        number = F.lpad(F.floor(F.instr(F.lit(_NUMBERS), F.lower(F.left(F.regexp_extract(found, pattern, month), F.lit(3)))) / 3 + 1).cast("string"), 2, "0")
        return F.when(found != "", _day(F.concat_ws("-", F.regexp_extract(found, pattern, 3), number, F.lpad(F.regexp_extract(found, pattern, day), 2, "0"))))

    return _let(F.regexp_extract(text, pattern, 0), day_of)


def from_text(page: Column) -> Column:
    """The first date written out, day or month first, outside copyright lines."""
    text = F.regexp_replace(page, r"(?is)<(script|style|footer)\b.*?</\1>", " ")
    for pattern in (_COPYRIGHT, "(?s)<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    return _let(text, lambda t: F.coalesce(_written(t, _DAY_MONTH, 1, 2), _written(t, _MONTH_DAY, 2, 1)))


def latest(as_of: dt.datetime) -> dt.datetime:
    """The cap for pages extracted on a day."""
    return as_of + dt.timedelta(days=AHEAD)


def publication_date(page: Column, url: Column, cap: Column | None = None, default: Column | None = None, linked: Column | None = None) -> Column:
    """When a page was published, as a timestamp without a zone at midnight; else `default`."""
    found = F.coalesce(from_url(url), from_tags(page, linked), from_text(page))
    if cap is not None:
        found = F.transform(F.array(found), lambda d: F.when(d <= cap, d))[0]
    return found if default is None else F.coalesce(found, default)
