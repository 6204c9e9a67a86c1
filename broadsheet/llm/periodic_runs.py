"""Periodic runs of words: stretches that repeat themselves at least MIN_EXPONENT times over.

A word is a number within its text. The array of numbers is compared with itself shifted by every lag up
to n / MIN_EXPONENT, many lags in one array operation; where words a lag apart stay equal for long enough
is a run. A text of up to MIN_EXPONENT * LAGS words is one range of lags and is scanned where it is read.
A longer one is dealt out: each range of LAGS lags goes to a task of its own with the numbers alone, four
bytes a word, and what the ranges find is brought together by row. No task holds more than one text, its
numbers, and BLOCK comparisons.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.common import crc32_sql, cut, table

#: A run repeats its period at least so many times and has at least so many words.
MIN_EXPONENT, MIN_WORDS = 3, 24
#: Lags of one range.
LAGS = 4096
#: Comparisons held at once, about; never fewer than one lag of the text.
BLOCK = 1 << 21
#: Rows that are handed on at once.
BATCH = 256
#: What parts words.
_BLANKS = r"[\x20\x09-\x0D]"

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than [\\x20\\x09-\\x0D], which no other character has a byte of."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first appearance among different words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def least_equal(lag: np.ndarray) -> np.ndarray:
    """Words that must equal those a lag further on, one after the other, to make a run."""
    return np.maximum(MIN_WORDS - lag, (MIN_EXPONENT - 1) * lag)


def stretches(ids: np.ndarray, low: int, high: int) -> Runs:
    """(start, length, lag) of what repeats at the lags from `low` to `high`, whether or not at a smaller lag too."""
    n, out = len(ids), []
    high = min(high, n // MIN_EXPONENT)
    if n < MIN_WORDS or high < low:
        return (np.zeros(0, np.int64),) * 3
    # beyond the end stands a number that no word has, and so the last comparison of every lag fails
    padded = np.concatenate([ids, np.full(high, -1, np.int32)])
    rows = max(1, BLOCK // n)
    for first in range(low, high + 1, rows):
        k = min(rows, high + 1 - first)
        shifted = np.lib.stride_tricks.as_strided(padded[first:], (k, n), (4, 4), writeable=False)
        equal = np.flatnonzero(shifted == ids)
        if not len(equal):
            continue
        ends = np.flatnonzero(np.diff(equal) != 1)
        begin, size = equal[np.r_[0, ends + 1]], np.diff(np.r_[-1, ends, len(equal) - 1])
        lag = first + begin // n
        good = size >= least_equal(lag)
        out.append((begin[good] % n, (size + lag)[good], lag[good]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))  # type: ignore[return-value]


def smallest_periods(found: Runs) -> Runs:
    """The runs, by start and then period.

    What repeats at a lag three times over and also at a smaller one has a period that divides the lag, and
    there it reaches just as far: so of stretches alike in both ends the smallest lag is the period.
    """
    start, length, lag = found
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, lag = start[first], length[first], lag[first]
    order = np.lexsort((lag, start))
    return start[order], length[order], lag[order]


def strongest(runs: Runs) -> int:
    """The place of the run of greatest length over period, then of least start and period.

    Quotients of whole numbers whose product is below 2**52 are equal as floats just when they are equal.
    """
    start, length, period = runs
    return int(np.lexsort((period, start, -(length / period)))[0])


def repeated(n: int, runs: Runs) -> np.ndarray:
    """For each word whether some run has it after its first period."""
    depth = np.zeros(n + 1, np.int64)
    start, length, period = runs
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) > 0


def _told(words: list[bytes], runs: Runs) -> dict:
    drop = repeated(len(words), runs)
    start, length, period = (c.tolist() for c in runs)
    return {
        "n_words": len(words),
        "runs": [{"start": s, "length": n, "period": q} for s, n, q in zip(start, length, period, strict=True)],
        "strongest": strongest(runs) if start else None,
        "collapsed": b" ".join(w for w, gone in zip(words, drop.tolist(), strict=True) if not gone).decode("utf-8", "surrogatepass"),
    }


_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("strongest", T.LongType()), T.StructField("collapsed", T.StringType())]
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("strongest", pa.int64()), ("collapsed", pa.string())])


def _batches(keys: pa.RecordBatch, told: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """`keys` beside what is told of each of its rows, BATCH rows at a time."""
    for low in range(0, keys.num_rows, BATCH):
        part = keys.slice(low, BATCH)
        found = pa.array([next(told) for _ in range(part.num_rows)], _FOUND_ARROW)
        yield pa.RecordBatch.from_arrays([*part.columns, *found.flatten()], [*part.schema.names, *(f.name for f in _FOUND_ARROW)])


def _here(rows: DataFrame) -> DataFrame:
    """The runs of texts that are one range of lags each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = (words_of(t.as_py()) for t in batch.column(1))
            yield from _batches(batch.select([0]), (_told(w, smallest_periods(stretches(ids := numbered(w), 1, len(ids)))) for w in split))

    return rows.mapInArrow(scan, T.StructType([rows.schema.fields[0], *_FOUND]))


def _dealt(rows: DataFrame, lags: int) -> DataFrame:
    """The runs of long texts, range of lags by range of lags, each range in whatever task it falls to."""
    # written once, as rows are told apart by number from here on
    held = cut(rows.withColumn("row_", F.monotonically_increasing_id()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = numbered(words_of(text.as_py()))
                for low in range(1, max(1, len(ids) // MIN_EXPONENT) + 1, lags):  # one row a batch, as each has the whole array
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()]), pa.array([low], pa.int64()), pa.array([ids.tobytes()])], ["row_", "low", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, low, ids in zip(*batch.columns, strict=True):
                start, length, lag = stretches(np.frombuffer(ids.as_buffer(), np.int32), low.as_py(), low.as_py() + lags - 1)
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(start), pa.int64()), pa.array(start), pa.array(length), pa.array(lag)], ["row_", "start", "length", "period"])

    ranges = held.select("row_", "text_").mapInArrow(deal, "row_ long, low long, ids binary").repartition("row_", "low")
    found = ranges.mapInArrow(scan, "row_ long, start long, length long, period long")
    # fewer than a text has words; a run's multiples fall away before they are gathered
    runs = found.groupBy("row_", "start", "length").agg(F.min("period").alias("period")).groupBy("row_").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs_"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a text may be of any length
                one = batch.slice(i, 1)
                got = one.column(2)[0].as_py() or []
                runs = tuple(np.array([r[k] for r in got], np.int64) for k in ("start", "length", "period"))
                yield from _batches(one.select([0]), iter([_told(words_of(one.column(1)[0].as_py()), smallest_periods(runs))]))

    return held.join(runs, "row_", "left").select("id_", "text_", "runs_").mapInArrow(tell, T.StructType([rows.schema.fields[0], *_FOUND]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lags: int | None = None) -> DataFrame:
    """One row per row of `docs`: id, n_words, runs (start, length, period of each, words counted from 0), strongest, collapsed.

    A run is a stretch of words with smallest period q, of at least MIN_WORDS words and MIN_EXPONENT * q,
    which neither neighbouring word prolongs. `strongest` is the place in `runs` of that with most
    repetitions; null without any. `collapsed` is the text's words, one space between them, without those
    that a run has after its first period.

    A null text counts as empty and has no words. Null ids and repeated rows come back as they are, each
    for itself; rows that share an id are judged by their own texts. Other columns are not read. An
    empty table gives an empty result.
    """
    lags = LAGS if lags is None else lags
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id_"), text.alias("text_"))
    one_range = MIN_EXPONENT * lags
    # words have a character and a blank at least, and so most texts needn't be counted
    n_words = F.when(F.length("text_") < 2 * one_range, 0).otherwise(F.regexp_count("text_", F.lit(r"[^\x20\x09-\x0D]+")))
    out = _here(rows.filter(n_words <= one_range)).unionByName(_dealt(rows.filter(n_words > one_range), lags))
    return out.withColumnRenamed("id_", id_col)


def with_repeats(text: Column, number: Column) -> Column:
    """The words of a text, one space between them; for one number in ten the rest from some word on repeats its own beginning.

    number: h of the contract. Texts of other numbers stay as they are.
    """
    words = F.filter(F.split(text, _BLANKS + "+"), lambda w: w != "")

    def rest(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(number / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " ")).otherwise("")

    return F.when(F.pmod(number, F.lit(10)) == 0, F.transform(F.array(words), rest)[0]).otherwise(text)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """periodic_runs() over the whole documents table, a tenth of its texts made to repeat themselves. A null id is numbered as an empty one."""
    docs = table(spark, sf_dir, "documents")
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    runs = periodic_runs(docs.select("doc_id", with_repeats(F.coalesce(F.col("text"), F.lit("")), number).alias("text")))
    best = F.get("runs", F.col("strongest").cast("int"))
    lines = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return runs.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Runs by another way: words that begin equal sequences of 16, the least that any run has a lag apart, are joined, and neighbours made into stretches.
OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), e AS (
  SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM (SELECT *, len(w) AS n FROM d)
), x AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM e
), grams AS (
  SELECT doc_id, unnest(range(n - 15)) AS i, unnest(list_transform(range(n - 15), lambda i: md5(array_to_string(w[i + 1:i + 16], ' ')))) AS gram FROM x WHERE n >= 24
), pairs AS (
  SELECT doc_id, p.i, q.i - p.i AS lag FROM grams p JOIN grams q USING (doc_id, gram) JOIN x USING (doc_id) WHERE p.i < q.i AND 3 * (q.i - p.i) <= n
), islands AS (
  SELECT doc_id, lag, min(i) AS start, count(*) + 15 + lag AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM pairs) GROUP BY doc_id, lag, island
), runs AS (
  SELECT doc_id, start, length, min(lag) AS period FROM islands WHERE length >= greatest(24, 3 * lag) GROUP BY doc_id, start, length
), told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         list({{'start': start, 'length': length, 'period': period}} ORDER BY length / period DESC, start, period)[1] AS best, list(start + period) AS froms, list(start + length) AS tos
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM x) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM x LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
