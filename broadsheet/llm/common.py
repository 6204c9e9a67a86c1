"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast lookup takes at most this many of the heaviest keys.
HEAVY_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where driver and executors are one process, as in tests, any will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/broadsheet-checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read from there, so that lost executors cost no more than their tasks."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def own_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores in front until no column of `df` has that name."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def lower_az(text: Column) -> Column:
    """A-Z lower-cased; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, values: Sequence[str]) -> DataFrame:
    """Left join with `right`, which has one row per key, in a way that hot keys cannot slow down.

    The HEAVY_KEYS heaviest keys of `right` are broadcast, a number that does not grow with the
    data; the others, each of which has few rows on the left, are joined by a shuffle. Left rows without
    a key are not shuffled. Every left row comes back once, with nulls where `right` lacks its key.
    """
    # ties at the cut make no difference: a key is in `heavy` or, if not, in `rest`
    heavy = F.broadcast(right.orderBy(F.desc(weight), F.asc(key)).limit(HEAVY_KEYS).select(key, *values, F.lit(True).alias("_heavy")))
    rest = right.join(heavy.select(key), key, "left_anti").select(key, *values)
    got = left.join(heavy, key, "left")
    hot = got.filter(F.col("_heavy") | F.col(key).isNull()).select(*left.columns, *values)
    cold = got.filter(F.col("_heavy").isNull() & F.col(key).isNotNull()).select(*left.columns).join(rest, key, "left")
    return hot.unionByName(cold.select(*left.columns, *values))


def _crc_of(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def crc32_sql(text: str) -> str:
    """SQL for an engine without the function: crc32 of a text's UTF-8 bytes, unsigned."""
    table_of = "[" + ", ".join(str(_crc_of(b)) for b in range(256)) + "]"
    in_hex = f"hex(encode({text}))"
    byte = f"CAST('0x' || substr({in_hex}, 2 * k + 1, 2) AS BIGINT)"
    return f"xor(list_reduce(list_transform(range(length({in_hex}) // 2), lambda k: {byte}), lambda c, b: xor(({table_of})[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"
