"""Exact de-duplication by a tree merge of sorted digest runs, with DataFrame functions only.

Each partition makes a run: its digests in order, each once, with the row that would stay and how many
rows there are. Runs are merged in binomial rounds. A run's number is read in digits of base FAN_IN; in
round i the FAN_IN runs that differ in digit i alone exchange: each keeps the part of the digests whose
own digit i is its number's, and sends the others. So a place ever receives FAN_IN sorted runs, merges
them in order, and has as much as before, a wider selection of runs and a narrower one of digests; after
as many rounds as the numbers have digits, every digest is in one place. A digest that every partition
holds has one row a run from the start, and FAN_IN rows at a place in any round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import cut, lookup, own_name, table

#: Characters that do not count when texts are compared: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Runs that one merge takes.
FAN_IN = 16
#: Parts of the digests of a run that are merged beside each other.
PARTS = 64


def rounds(n_runs: int, fan_in: int = FAN_IN) -> int:
    """Rounds after which so many runs are one: the digits of their numbers."""
    n, reach = 0, 1
    while reach < n_runs:
        n, reach = n + 1, reach * fan_in
    return n


def _digit(number: Column, i: int, fan_in: int) -> Column:
    return F.pmod(F.floor(number / F.lit(fan_in**i)), F.lit(fan_in)).cast("long")


def merged(runs: DataFrame) -> DataFrame:
    """What stands at each place, as one sorted run.

    A place's rows are read in order, those of one digest next to each other. Of those that agree in
    digest and also in length, at most one from each run, the least `best` is kept, and their numbers of
    rows are added up.
    """
    alike = Window.partitionBy("place", "part", "text_sha256", "n_norm").orderBy("best")
    whole = alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = runs.repartition("place", "part").select("place", "part", "text_sha256", "n_norm", "best", F.sum("n").over(whole).alias("n"), F.row_number().over(alike).alias("nth"))
    return met.filter("nth = 1").drop("nth")


def tree_merge(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN, parts: int = PARTS) -> DataFrame:
    """(text_sha256, n_norm, best, n) of all runs, from runs of (run, text_sha256, n_norm, best, n) numbered from 0 on."""
    number = F.conv(F.substring("text_sha256", 1, 12), 16, 10).cast("long")
    part = F.pmod(F.conv(F.substring("text_sha256", 13, 8), 16, 10).cast("long"), F.lit(parts))
    runs = runs.select(F.col("run").cast("long").alias("place"), part.alias("part"), "text_sha256", "n_norm", "best", "n")
    for i in range(rounds(n_runs, fan_in)):
        place = F.col("place") + (_digit(number, i, fan_in) - _digit(F.col("place"), i, fan_in)) * F.lit(fan_in**i)
        runs = merged(runs.withColumn("place", place))
    return runs.select("text_sha256", "n_norm", "best", "n")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256, n_points.

    Texts are equal when identical without the characters of BLANKS. Of a group stays the row with
    most code points in its original text, then the smallest id, then the first of rows that repeat
    each other, so that exactly one row of a group is kept. A null text counts as empty; empty texts
    form one group. Null ids sort last. Other columns are not read. An empty table gives an empty
    result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = F.translate(text, BLANKS, "")
    # numbered, digested and written once: the numbers must not change between the two uses below
    rows = cut(
        docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_points"), norm.alias("norm")).select(
            "doc_id", "n_points", F.length("norm").cast("long").alias("n_norm"), F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row_id"), F.spark_partition_id().alias("run")
        )
    )
    best = F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    runs = rows.groupBy("run", "text_sha256", "n_norm").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    n_runs = (rows.agg(F.max("run").alias("last")).first()["last"] or 0) + 1
    groups = tree_merge(runs, n_runs, fan_in).filter("n > 1").select("text_sha256", F.col("best.doc_id").alias("best_id"), F.col("best.row_id").alias("best_row"), "n")
    found = lookup(rows.select("doc_id", "text_sha256", "row_id", "n_points"), groups, "text_sha256", "n", ["best_id", "best_row", "n"])
    alone = F.col("n").isNull()
    return found.select(
        F.col("doc_id").alias(id_col),
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_id") == F.col("best_row"))).alias("kept"),
        "text_sha256",
        "n_points",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of `docs` that dedup_exact() keeps, with all their columns.

    Of rows alike in id, length and text but for blanks any one stays. Such rows are brought down to one in
    every task before anything is shuffled, so that it makes no difference how many of them there are.
    """
    place, row = own_name(docs, "place_"), own_name(docs, "row_")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of = lambda digest, points, id_: F.sha2(F.concat_ws("|", digest, points, F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit(""))), 256)
    kept = dedup_exact(docs, id_col, text_col, fan_in).filter("kept").select(of(F.col("text_sha256"), F.col("n_points"), F.col(id_col)).alias(place))
    one = docs.groupBy(of(F.sha2(F.translate(text, BLANKS, ""), 256), F.length(text), F.col(id_col)).alias(place)).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(row))
    return one.join(kept, place, "left_semi").select(f"{row}.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_exact() over the whole documents table."""
    return dedup_exact(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS h
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       h AS text_sha256
FROM d
WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
