"""Canonical domains: the registered part of a host, or the whole name where sites live on subdomains."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.urls import host, ip_host, normalize

#: Services whose subdomains are sites of their own.
BLOG_SERVICES = (
    r"\.go\.com", r"\.wordpress\.com", r"\.blogspot\.", r"\.livejournal\.com", r"\.privet\.ru", r"\.wikia\.com", r"\.24open\.ru", r"\.patch\.com",
    r"\.tumblr\.com", r"\.github\.io", r"\.typepad\.com", r"\.squarespace\.com", r"\.substack\.com", r"\.iheart\.com", r"\.ampproject\.org",
    r"\.mail\.ru", r"\.wixsite\.com", r"\.medium.com", r"\.free\.fr", r"\.list-manage\.com", r"\.over-blog\.com", r"\.weebly\.com",
    r"\.typeform\.com", r"\.nationbuilder\.com", r"\.tripod\.com", r"\.insanejournal\.com", r"\.cloudfront\.net", r"\.wpengine\.com",
    r"\.noblogs\.org", r"\.formstack\.com", r"\.altervista\.org", r"\.home\.blog", r"\.kinja\.com", r"\.sagepub\.com", r"\.ning\.com",
    r"\.hypotheses\.org", r"\.narod\.ru", r"\.submittable\.com", r"\.smalltownpapers\.com", r"\.herokuapp\.com", r"\.newsvine\.com",
    r"\.newsmemory\.com", r"\.beforeitsnews\.com", r"\.jimdo\.com", r"\.wickedlocal\.com", r"\.radio\.com", r"\.stackexchange\.com",
    r"\.buzzsprout\.com", r"\.appspot\.com", r"\.simplecast\.com", r"\.fc2\.com", r"\.podomatic\.com", r"\.azurewebsites\.", r"\.sharepoint\.com",
    r"\.windows\.net", r"\.wix\.com", r"\.googleblog\.com", r"\.hubpages\.com", r"\.gitlab\.io", r"\.blogs\.com", r"\.shinyapps\.io",
)
BLOG = "(?i)" + "|".join(BLOG_SERVICES)


@dataclass(frozen=True)
class Suffixes:
    """The rules of a public suffix list: plain ones, those whose every child is a suffix, and children that are none."""

    plain: frozenset[str]
    wild: frozenset[str]
    exceptions: frozenset[str]

    @classmethod
    def of(cls, lines: Iterable[str]) -> Suffixes:
        """From the lines of a list; names are taken in the form that hosts have in URLs."""
        rules = [r.strip() for r in lines]
        rules = [r.encode("idna").decode() if not r.isascii() and r[0] not in "*!" else r for r in rules if r and not r.startswith("//")]
        return cls(frozenset(r for r in rules if r[0] not in "*!"), frozenset(r[2:] for r in rules if r.startswith("*.")), frozenset(r[1:] for r in rules if r.startswith("!")))

    def labels(self) -> int:
        """The most labels that a suffix has."""
        return max((r.count(".") + 1 + (r in self.wild) for r in self.plain | self.wild), default=1)


@functools.lru_cache(1)
def known_suffixes() -> Suffixes:
    """The list that comes with the package."""
    return Suffixes.of(resources.files("broadsheet.data").joinpath("public_suffix_list.dat").read_text("utf-8").splitlines())


@functools.lru_cache(4)
def _rule(suffixes: Suffixes) -> str:
    """A SQL function of a host that gives its longest public suffix: its endings, each tested by a list of names of its length.

    It is text, as the list would take a call to the JVM for each name otherwise.
    """
    end = lambda i: f"substring_index(h, '.', -{i})"
    among = lambda i, names: f"{end(i)} IN (" + ", ".join("'" + n.replace("\\", "").replace("'", "") + "'" for n in names) + ")"
    of_size = lambda names, i: sorted(n for n in names if n.count(".") + 1 == i)
    cases = []
    for i in range(suffixes.labels(), 0, -1):
        tests = [among(i, listed)] if (listed := of_size(suffixes.plain | suffixes.wild, i)) else []
        if above := of_size(suffixes.wild, i - 1):
            spared = of_size(suffixes.exceptions, i)
            tests.append(f"{among(i - 1, above)} AND {end(i)} <> {end(i - 1)}" + (f" AND NOT {among(i, spared)}" if spared else ""))
        if tests:
            cases.append(f"WHEN {' OR '.join(f'({t})' for t in tests)} THEN {end(i)}")
    return f"h -> CASE {' '.join(cases)} END" if cases else "h -> CAST(NULL AS STRING)"


def public_suffix(name: Column, suffixes: Suffixes | None = None) -> Column:
    """The longest public suffix that a host ends in; null without one.

    A host has few endings, and each is looked for among the rules of as many labels, which Spark keeps as
    a hash set. Nothing is joined.
    """
    return F.call_function("transform", F.array(name), F.expr(_rule(suffixes or known_suffixes())))[0]


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(x), body)[0]


def _main(name: Column, suffix: Column) -> Column:
    rest = F.when(F.length(name) > F.length(suffix) + 1, F.left(name, F.length(name) - F.length(suffix) - 1)).otherwise(F.lit(""))
    return F.when(suffix.isNull() | (rest == ""), F.lit("")).otherwise(F.concat(F.substring_index(rest, ".", -1), F.lit("."), suffix))


def registered(name: Column, suffixes: Suffixes | None = None) -> Column:
    """The public suffix and the label before it; empty where there is no such label."""
    return _let(public_suffix(name, suffixes), lambda suffix: _main(name, suffix))


def canonical_domain(url: Column, suffixes: Suffixes | None = None, normal: Column | None = None) -> Column:
    """The name that a URL's site goes by. `normal` is its normal form, where that is known already.

    An address is itself; on services for blogs, which are looked for in the whole normal form, the
    subdomain is part of the name; cached copies count for their origin; a host that is nothing but a
    public suffix is that suffix.
    """

    def of(normal: Column) -> Column:
        parts = F.struct(normal.alias("url"), host(normal).alias("host"))
        return _let(parts, lambda p: _let(F.struct(p["url"].alias("url"), p["host"].alias("host"), public_suffix(p["host"], suffixes).alias("suffix")), named))

    def named(p: Column) -> Column:
        h, suffix = p["host"], p["suffix"]

        def with_main(main: Column) -> Column:
            sub = F.when(F.length(h) > F.length(main) + 1, F.left(h, F.length(h) - F.length(main) - 1)).otherwise(F.lit(""))
            name = F.when(p["url"].rlike(BLOG), F.concat(sub, F.lit("."), main)).otherwise(main)
            return _let(name, lambda d: F.when(F.contains(d, F.lit("cdn.ampproject.org")), _origin(d)).when((d == "") & (suffix == h), h).otherwise(d))

        return _let(_main(h, suffix), with_main)

    return F.coalesce(ip_host(url), _let(normalize(url) if normal is None else normal, of))


def _origin(cached: Column) -> Column:
    """The host that a cached copy is of, from the cache's name for it."""
    out = cached
    for old, new in ((".cdn.ampproject.org", ""), ("amp-", ""), ("/", ""), ("--", "-"), ("-", ".")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out
