"""The few operations that URL, title and tag expressions are made of, for Spark and for the SQL oracle.

An expression is written once over a dialect. With `SPARK` it is a Column that Catalyst compiles; with
`DUCK` it is the text of an ANSI-style SQL expression that another engine can run on the same tables.
Patterns keep to what Java's and RE2's regular expressions have in common.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]


@dataclass(frozen=True)
class Form:
    """A rewrite that the other operations can't express, as a SQL lambda of each engine; without one for the other engine it leaves all as it is there."""

    spark: str
    duck: str = ""


class Spark:
    """Columns."""

    def lit(self, value: Any) -> Column:
        return F.lit(value)

    def replace(self, x: Column, pattern: str, by: str) -> Column:
        return F.regexp_replace(x, pattern, by)

    def extract(self, x: Column, pattern: str, group: int = 0) -> Column:
        """The first match; empty where there is none."""
        return F.regexp_extract(x, pattern, group)

    def test(self, x: Column, pattern: str) -> Column:
        return x.rlike(pattern)

    def swap(self, x: Column, old: str, new: str) -> Column:
        return F.replace(x, F.lit(old), F.lit(new))

    def lower(self, x: Column) -> Column:
        return F.lower(x)

    def concat(self, *xs: Column) -> Column:
        return F.concat(*xs)

    def case(self, *branches: tuple[Column, Column], other: Column) -> Column:
        first = F.when(*branches[0])
        return reduce(lambda c, b: c.when(*b), branches[1:], first).otherwise(other)

    def let(self, x: Column, body: Callable[[Column], Column]) -> Column:
        """`body` with its argument computed once; nesting without it would grow threefold at each step."""
        return F.transform(F.array(x), body)[0]

    def left(self, x: Column, n: Column) -> Column:
        return F.left(x, n)

    def since(self, x: Column, n: Column) -> Column:
        """From the n-th character on, the first being 1."""
        return F.substr(x, n)

    def length(self, x: Column) -> Column:
        return F.length(x).cast("long")

    def split(self, x: Column, sep: str) -> Column:
        return F.split(x, "".join(f"[{c}]" for c in sep))

    def split_on(self, x: Column, pattern: str) -> Column:
        return F.split(x, pattern)

    def keep(self, xs: Column, test: Callable[[Column], Column]) -> Column:
        return F.filter(xs, test)

    def any(self, xs: Column, test: Callable[[Column], Column]) -> Column:
        return F.exists(xs, test)

    def map(self, xs: Column, f: Callable[[Column], Column]) -> Column:
        return F.transform(xs, f)

    def sort(self, xs: Column) -> Column:
        return F.array_sort(xs)

    def join(self, xs: Column, sep: str) -> Column:
        return F.array_join(xs, sep)

    def size(self, xs: Column) -> Column:
        return F.size(xs).cast("long")

    def at(self, xs: Column, n: int) -> Column:
        """The n-th, the first being 1, the last -1; null beyond."""
        return F.try_element_at(xs, F.lit(n))

    def sum_after(self, xs: Column, n: Column, add: int) -> Column:
        """The sum of `add` and each element after the n-th."""
        return F.aggregate(F.transform(F.filter(xs, lambda _, i: i >= n), lambda v: v + add), F.lit(0).cast("long"), lambda a, v: a + v)

    def last_from(self, xs: Column, least: int) -> Column:
        """The place of the last element that is at least `least`."""
        return F.array_max(F.transform(xs, lambda v, i: F.when(v >= least, i + 1).otherwise(0))).cast("long")

    def first_given(self, *xs: Column) -> Column:
        return F.coalesce(*xs)

    def none_if(self, x: Column, value: str) -> Column:
        return F.nullif(x, F.lit(value))

    def starts(self, x: Column, y: Column) -> Column:
        return F.startswith(x, y)

    def has(self, x: Column, y: Column) -> Column:
        return F.contains(x, y)

    def among(self, x: Column, values: Sequence[str]) -> Column:
        return x.isin(*values)

    def both(self, *xs: Column) -> Column:
        return reduce(lambda a, b: a & b, xs)

    def either(self, *xs: Column) -> Column:
        return reduce(lambda a, b: a | b, xs)

    def no(self, x: Column) -> Column:
        return ~x

    def absent(self, x: Column) -> Column:
        return x.isNull()

    def less(self, a: Column, b: Column) -> Column:
        return a < b

    def same(self, a: Column, b: Column) -> Column:
        return a == b

    def plus(self, a: Column, b: Column) -> Column:
        return a + b

    def minus(self, a: Column, b: Column) -> Column:
        return a - b

    def sha256(self, x: Column) -> Column:
        return F.sha2(x, 256)

    def form(self, x: Column, rewrite: Form) -> Column:
        return F.call_function("transform", F.array(x), F.expr(rewrite.spark))[0]


class Duck:
    """SQL text."""

    def __init__(self) -> None:
        self.names = 0

    def _name(self) -> str:
        self.names += 1
        return f"v{self.names}"

    def lit(self, value: Any) -> str:
        return str(value) if not isinstance(value, str) else "'" + value.replace("'", "''") + "'"

    def replace(self, x: str, pattern: str, by: str) -> str:
        by = by.replace("\\", "\\\\")
        for g in "123":
            by = by.replace(f"${g}", f"\\{g}")
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def test(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def swap(self, x: str, old: str, new: str) -> str:
        return f"replace({x}, {self.lit(old)}, {self.lit(new)})"

    def lower(self, x: str) -> str:
        return f"lower({x})"

    def concat(self, *xs: str) -> str:
        return "(" + " || ".join(xs) + ")"

    def case(self, *branches: tuple[str, str], other: str) -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {other} END"

    def let(self, x: str, body: Callable[[str], str]) -> str:
        v = self._name()
        return f"list_transform([{x}], lambda {v}: {body(v)})[1]"

    def left(self, x: str, n: str) -> str:
        return f"substring({x}, 1, greatest({n}, 0))"

    def since(self, x: str, n: str) -> str:
        return f"substring({x}, {n})"

    def length(self, x: str) -> str:
        return f"length({x})"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.lit(sep)})"

    def split_on(self, x: str, pattern: str) -> str:
        return f"string_split_regex({x}, {self.lit(pattern)})"

    def keep(self, xs: str, test: Callable[[str], str]) -> str:
        v = self._name()
        return f"list_filter({xs}, lambda {v}: {test(v)})"

    def any(self, xs: str, test: Callable[[str], str]) -> str:
        return f"(len({self.keep(xs, test)}) > 0)"

    def map(self, xs: str, f: Callable[[str], str]) -> str:
        v = self._name()
        return f"list_transform({xs}, lambda {v}: {f(v)})"

    def sort(self, xs: str) -> str:
        return f"list_sort({xs})"

    def join(self, xs: str, sep: str) -> str:
        return f"array_to_string({xs}, {self.lit(sep)})"

    def size(self, xs: str) -> str:
        return f"len({xs})"

    def at(self, xs: str, n: int) -> str:
        return f"({xs})[{n}]"

    def sum_after(self, xs: str, n: str, add: int) -> str:
        v = self._name()
        return f"CAST(coalesce(list_sum(list_transform(({xs})[({n}) + 1:], lambda {v}: {v} + {add})), 0) AS BIGINT)"

    def last_from(self, xs: str, least: int) -> str:
        v, i = self._name(), self._name()
        return f"list_max(list_transform({xs}, lambda {v}, {i}: CASE WHEN {v} >= {least} THEN {i} ELSE 0 END))"

    def first_given(self, *xs: str) -> str:
        return f"coalesce({', '.join(xs)})"

    def none_if(self, x: str, value: str) -> str:
        return f"nullif({x}, {self.lit(value)})"

    def starts(self, x: str, y: str) -> str:
        return f"starts_with({x}, {y})"

    def has(self, x: str, y: str) -> str:
        return f"contains({x}, {y})"

    def among(self, x: str, values: Sequence[str]) -> str:
        return f"({x} IN ({', '.join(map(self.lit, values))}))"

    def both(self, *xs: str) -> str:
        return "(" + " AND ".join(xs) + ")"

    def either(self, *xs: str) -> str:
        return "(" + " OR ".join(xs) + ")"

    def no(self, x: str) -> str:
        return f"(NOT {x})"

    def absent(self, x: str) -> str:
        return f"({x} IS NULL)"

    def less(self, a: str, b: str) -> str:
        return f"({a} < {b})"

    def same(self, a: str, b: str) -> str:
        return f"({a} = {b})"

    def plus(self, a: str, b: str) -> str:
        return f"({a} + {b})"

    def minus(self, a: str, b: str) -> str:
        return f"({a} - {b})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def form(self, x: str, rewrite: Form) -> str:
        return f"list_transform([{x}], {rewrite.duck})[1]" if rewrite.duck else x


class SparkSql(Duck):
    """SQL text for Spark, for functions that a session knows by name."""

    def lit(self, value: Any) -> str:
        return str(value) if not isinstance(value, str) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)})"

    def test(self, x: str, pattern: str) -> str:
        return f"rlike({x}, {self.lit(pattern)})"

    def concat(self, *xs: str) -> str:
        return f"concat({', '.join(xs)})"

    def let(self, x: str, body: Callable[[str], str]) -> str:
        v = self._name()
        return f"transform(array({x}), {v} -> {body(v)})[0]"

    def left(self, x: str, n: str) -> str:
        return f"left({x}, {n})"

    def length(self, x: str) -> str:
        return f"CAST(length({x}) AS BIGINT)"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit(''.join(f'[{c}]' for c in sep))})"

    def split_on(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.lit(pattern)})"

    def keep(self, xs: str, test: Callable[[str], str]) -> str:
        v = self._name()
        return f"filter({xs}, {v} -> {test(v)})"

    def any(self, xs: str, test: Callable[[str], str]) -> str:
        v = self._name()
        return f"exists({xs}, {v} -> {test(v)})"

    def map(self, xs: str, f: Callable[[str], str]) -> str:
        v = self._name()
        return f"transform({xs}, {v} -> {f(v)})"

    def sort(self, xs: str) -> str:
        return f"array_sort({xs})"

    def join(self, xs: str, sep: str) -> str:
        return f"array_join({xs}, {self.lit(sep)})"

    def size(self, xs: str) -> str:
        return f"CAST(size({xs}) AS BIGINT)"

    def at(self, xs: str, n: int) -> str:
        return f"try_element_at({xs}, {n})"

    def sum_after(self, xs: str, n: str, add: int) -> str:
        v, i, a = self._name(), self._name(), self._name()
        return f"aggregate(transform(filter({xs}, ({v}, {i}) -> {i} >= {n}), {v} -> {v} + {add}), CAST(0 AS BIGINT), ({a}, {v}) -> {a} + {v})"

    def last_from(self, xs: str, least: int) -> str:
        v, i = self._name(), self._name()
        return f"CAST(array_max(transform({xs}, ({v}, {i}) -> CASE WHEN {v} >= {least} THEN {i} + 1 ELSE 0 END)) AS BIGINT)"

    def starts(self, x: str, y: str) -> str:
        return f"startswith({x}, {y})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def form(self, x: str, rewrite: Form) -> str:
        return f"transform(array({x}), {rewrite.spark})[0]"


SPARK = Spark()
DUCK = Duck()
SPARK_SQL = SparkSql()


def rewritten(x: Any, rules: Rules, on: Any = SPARK) -> Any:
    """The rules applied one after the other, each to all its matches."""
    return reduce(lambda c, r: on.replace(c, *r), rules, x)


#: What Python strips: Unicode white space, which `\s` alone does not cover in either engine.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(x: Any, on: Any = SPARK) -> Any:
    """Without white space at either end."""
    return on.replace(x, f"^{BLANK}+|{BLANK}+$", "")


def squeezed(x: Any, on: Any = SPARK) -> Any:
    """With one space for each run of white space."""
    return on.replace(x, f"{BLANK}+", " ")


def found(x: Any, pattern: str, group: int, on: Any = SPARK) -> Any:
    """The group of the first match; null without one. The group itself must not match emptiness."""
    return on.none_if(on.extract(x, pattern, group), "")
