"""What the fields of a record are for: de-duplication, summaries, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import content, languages, text, titles, urls
from broadsheet.plans.dialect import SPARK_SQL

#: Rows of a comparison report, as a report is for reading.
REPORT_ROWS = 200


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal keys the one that is first in `order`; rows with a null key all stay.

    The smallest order is found by an aggregation with a partial step before the shuffle, so that a key
    that a third of the rows have does not meet in one task.
    """
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    return df.join(best, [key, order], "left_semi").unionByName(df.filter(F.col(key).isNull()))


def groups_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keys that several rows have: key, n and the first row."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter("n > 1")


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows for each key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def drop_non_news(df: DataFrame, host: Column) -> DataFrame:
    """Without pages of sites that carry no news, by an anti join on the host's endings.

    The list is of fixed length and goes to every worker.
    """
    spark = df.sparkSession
    sites = F.broadcast(spark.createDataFrame([(d,) for d in urls.NON_NEWS_DOMAINS], "site string"))
    ends = F.lower(host)
    return df.join(sites, (ends == F.col("site")) | ends.endswith(F.concat(F.lit("."), F.col("site"))), "left_anti")


def only_shortened(df: DataFrame, host: Column, shorteners: Sequence[str] = tuple(urls.SHORTENERS)) -> DataFrame:
    """Pages whose host is a known shortener's."""
    names = df.sparkSession.createDataFrame([(s,) for s in shorteners], "shortener string")
    return df.join(F.broadcast(names) if len(shorteners) <= 100_000 else names, F.lower(host) == F.col("shortener"), "left_semi")


def method_stats(df: DataFrame, method: str = "text_extraction_method", status: str = "extract_status") -> DataFrame:
    """How many pages each method read, and with what outcome."""
    return df.groupBy(method, status).agg(F.count(F.lit(1)).alias("n"))


def comparison(truth: DataFrame, guess: DataFrame, key: str, fields: Sequence[str], date: str | None = None, limit: int | None = REPORT_ROWS) -> DataFrame:
    """For each field of both tables: truth, guess and whether they agree; and days from guess to truth.

    Keys without a guess are left out. The report has its first `limit` keys; None for all.
    """
    names = [*fields, *([date] if date else [])]
    both = truth.select(key, *(F.col(f).alias(f"{f}_truth") for f in names)).join(guess.select(key, *(F.col(f).alias(f"{f}_guess") for f in names)), key)
    out = both.select("*", *(F.coalesce(F.col(f"{f}_truth") == F.col(f"{f}_guess"), F.lit(False)).alias(f"{f}_agrees") for f in fields))
    if date:
        out = out.withColumn("days_off", F.datediff(f"{date}_truth", f"{date}_guess"))
    return out.orderBy(key).limit(limit) if limit else out


def stage_shares(seconds: DataFrame, stage: str = "stage", value: str = "seconds") -> DataFrame:
    """The share of each stage in the total, in per cent."""
    total = seconds.agg(F.sum(value).alias("total"))
    return seconds.groupBy(stage).agg(F.sum(value).alias(value)).crossJoin(F.broadcast(total)).select(stage, value, F.round(100 * F.col(value) / F.col("total"), 2).alias("percent"))


def mined_urls(lines: DataFrame, column: str = "value") -> DataFrame:
    """The distinct URLs in quotes in a table of text, but for pictures."""
    found = lines.select(F.explode(F.regexp_extract_all(column, F.lit(r"https?://[^\s\"'<>)]+"), 0)).alias("url"))
    return found.filter(~F.lower("url").rlike(r"\.jpe?g$")).distinct()


def stage_counts(records: DataFrame, name: str = "stages") -> tuple[DataFrame, Observation]:
    """The records, and what is counted as they pass: pages, and those with a date, text, title and language."""
    seen = Observation(name)
    filled = {"pub_date": "publication_date", "content": "text_content", "title": "article_title", "language": "language"}
    return records.observe(seen, F.count(F.lit(1)).alias("total"), *(F.count(c).alias(k) for k, c in filled.items())), seen


def register(spark: SparkSession) -> None:
    """The functions under names that a session's SQL knows: inlined where they are native, Arrow UDFs where not."""
    on = SPARK_SQL
    native = {
        "fix_url": ("STRING", urls.fix_mistakes("x", on)),
        "normalize_url": ("STRING", urls.normalize("x", on)),
        "url_hash": ("STRING", urls.url_hash("x", on)),
        "url_host": ("STRING", urls.host("x", on)),
        "feed_url": ("STRING", urls.feed_normalize("x", on)),
        "is_homepage_url": ("BOOLEAN", urls.is_homepage("x", on)),
        "is_shortened_url": ("BOOLEAN", urls.is_shortened("x", on)),
        "is_non_news_domain": ("BOOLEAN", urls.is_non_news("x", on)),
        "strip_tags": ("STRING", text.strip_tags("x", on)),
        "title_from_html": ("STRING", titles.from_html("x", on=on)),
        "normalize_title": ("STRING", titles.normalize_title("x", on)),
        "language_from_tags": ("STRING", languages.from_tags("x", on)),
        "canonical_url": ("STRING", content.canonical_url("x", on)),
    }
    for name, (kind, body) in native.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    spark.udf.register("strip_tags_exact", text.strip_tags_exact)
    spark.udf.register("unescape_exact", text.unescape_exact)
    spark.udf.register("raw_text", content.raw_text)
