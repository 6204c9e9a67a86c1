"""The folder that all executors see, and tables that are written there once and read from then on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """That in spark.checkpoint.dir. Where driver and executors are one process, as in tests, any will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"{tempfile.gettempdir()}/broadsheet-shared"


def written(df: DataFrame) -> DataFrame:
    """`df` as a checkpoint in that folder, for what is read more than once."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)
