"""De-duplication of a stream of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import urls


def dedup_stream(pages: DataFrame, seen: str, watermark: str = "1 day", url_col: str = "url") -> DataFrame:
    """The first page of each normal form within the watermark of the time column `seen`.

    State is one row for each hash that the watermark has not passed. Pages without a URL go around it, and
    all come through.
    """
    hashed = pages.withColumn("unique_url_hash", urls.url_hash(F.col(url_col)))
    known = hashed.filter(F.col("unique_url_hash").isNotNull()).withWatermark(seen, watermark).dropDuplicatesWithinWatermark(["unique_url_hash"])
    return known.unionByName(hashed.filter(F.col("unique_url_hash").isNull()).withWatermark(seen, watermark))


def hourly_counts(pages: DataFrame, seen: str, watermark: str = "1 hour") -> DataFrame:
    """Pages of each hour and host, late ones as far as the watermark lets them."""
    return pages.withWatermark(seen, watermark).groupBy(F.window(seen, "1 hour").alias("hour"), urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
