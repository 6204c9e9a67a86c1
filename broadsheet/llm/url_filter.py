"""URL filters: glob rules packed into a multiword Shift-And automaton.

Every rule is a glob over `host + path`. All globs are laid end to end in one row of bits, 64 to a
word, and one step of the automaton moves all of them over one byte of the URL. A batch of URLs is a
matrix of states, so that a step is a few numpy operations whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.common import own_name, table

#: (verdict, host and path), in the order in which they are given.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The verdict on a URL that no rule fits.
OTHERWISE = "allow"
#: States of so many URLs are stepped together; the matrix stays small whatever the batch.
ROWS_AT_ONCE = 4096
#: After so many bytes, and again after as many, URLs whose states no byte can change are taken out.
SETTLED_EVERY = 64


@dataclass
class Automaton:
    """Shift-And masks of many globs.

    In a glob, `*` is any run of bytes without `/`, `**` any run of bytes, `?` one byte; all else is
    itself. A glob must fit the whole text.
    """

    globs: Sequence[str]
    words: int = field(init=False)

    def __post_init__(self) -> None:
        literals: list[tuple[int, int | None]] = []  # (bit, its byte or None for any)
        loops: list[tuple[int, bool]] = []  # (bit, whether "/" is let through)
        starts, ends, bit = [], [], 0
        for glob in self.globs:
            raw, at = glob.encode(), 0
            starts.append(bit)  # a bit that stands for "nothing read yet" opens each glob
            while at < len(raw):
                if raw[at : at + 2] == b"**":
                    loops.append((bit, True))
                    at += 2
                    continue
                if raw[at : at + 1] == b"*":
                    loops.append((bit, False))
                else:
                    bit += 1
                    literals.append((bit, None if raw[at : at + 1] == b"?" else raw[at]))
                at += 1
            ends.append(bit)
            bit += 1
        self.words = bit // 64 + 1
        self.step = np.zeros((256, self.words), np.uint64)
        self.final = np.zeros(self.words, np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        self.ends = ends
        one = lambda b: (b // 64, np.uint64(1) << np.uint64(b % 64))
        for b, byte in literals:
            w, m = one(b)
            self.step[slice(None) if byte is None else byte, w] |= m
        not_slash = np.arange(256) != ord("/")
        for b, slash in loops:
            w, m = one(b)
            self.stay[slice(None) if slash else not_slash, w] |= m
        for b in starts:
            w, m = one(b)
            self.first[w] |= m
        for b in {b for b, slash in loops if slash} & set(ends):  # what ends in "**" fits whatever follows
            w, m = one(b)
            self.final[w] |= m

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Whether text i fits glob j."""
        out = np.zeros((len(texts), len(self.globs)), bool)
        for low in range(0, len(texts), ROWS_AT_ONCE):
            out[low : low + ROWS_AT_ONCE] = self._match(texts[low : low + ROWS_AT_ONCE])
        return out

    def _match(self, texts: Sequence[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(texts) else lengths
        order = np.argsort(-lengths, kind="stable")
        lengths, begin = lengths[order], begin[order]
        state = np.repeat(self.first[None, :], len(texts), 0)
        live = len(texts)
        for at in range(int(lengths[0]) if len(texts) else 0):
            live = min(live, int(np.searchsorted(-lengths, -at, "left")))  # only URLs that have this byte
            if at and at % SETTLED_EVERY == 0:
                open_ = (state[:live] & ~self.final).any(1)
                if not open_.all():  # those that are settled go behind the others, which stay in order of length
                    turn = np.concatenate((np.flatnonzero(open_), np.flatnonzero(~open_)))
                    for x in (state, order, begin, lengths):
                        x[:live] = x[:live][turn]
                    live = int(open_.sum())
                    lengths = np.concatenate((lengths[:live], np.zeros(len(lengths) - live, lengths.dtype)))
            if not live:
                break
            now = state[:live]
            byte = flat[begin[:live] + at]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[byte]) | (now & self.stay[byte])
        got = np.empty((len(texts), len(self.globs)), bool)
        for j, b in enumerate(self.ends):
            got[order, j] = (state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) == 1
        return got


def rule_globs(rule: str) -> list[str]:
    """The globs of one rule `host/path`, which may have wildcards: the host itself and any of its subdomains, and all that begins so."""
    return [f"{rule}**", f"*.{rule}**"]


def ranked(rules: Sequence[tuple[str, str]]) -> list[int]:
    """Rule numbers, the one that wins first: longest, then block before allow, then as given."""
    return sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), rules[i][0] != "block", i))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, otherwise: str = OTHERWISE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of `pages`: its id, host, path, rule and verdict.

    Host: what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path:
    from there up to `?`, `#` or the end. Both are empty for a null url and one without `://`. Of the
    rules that fit, the longest wins; where none does, rule is null and the verdict `otherwise`. A rule
    is a host and the beginning of a path; `*`, `**` and `?` in it are wildcards, see Automaton. Other
    columns are not read; repeated rows and null ids come back as they are.
    """
    order = ranked(rules)
    globs = [g for i in order for g in rule_globs(rules[i][1])]
    name = [rules[i][1] for i in order]
    says = [rules[i][0] for i in order]
    automaton = Automaton(globs)

    after = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    rest = own_name(pages, "rest")
    parts = pages.select(F.col(id_col), after.alias(rest)).select(
        id_col,
        F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [f"{h}{p}".encode() for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            fits = automaton.match(texts)
            either = fits[:, 0::2] | fits[:, 1::2]
            some = either.any(1) if name else np.zeros(len(texts), bool)
            best = either.argmax(1) if name else np.zeros(len(texts), np.int64)
            rule = pa.array([name[b] if s else None for s, b in zip(some, best, strict=True)], pa.string())
            verdict = pa.array([says[b] if s else otherwise for s, b in zip(some, best, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [id_col, "host", "path", "rule", "verdict"])

    schema = T.StructType([*parts.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return parts.mapInArrow(judge, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filter_urls() over the whole pages table."""
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    rows = ",\n    ".join(f"({rank}, '{RULES[i][1].partition('/')[0]}', '/{RULES[i][1].partition('/')[2]}', '{RULES[i][0]}')" for rank, i in enumerate(ranked(RULES)))
    return rf"""
WITH rules(rank, rule_host, rule_path, verdict) AS (
  VALUES {rows}
), cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS line
  FROM cut
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_min(rule_host || rule_path, rank) AS rule, coalesce(arg_min(verdict, rank), '{OTHERWISE}') AS verdict
FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id, line
"""


OP4_SQL = _sql()
