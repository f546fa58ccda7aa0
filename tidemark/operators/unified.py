"""One pipeline for batch and stream, and the two-layer design it replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eventtime import drop_behind


def count_step(df: DataFrame, key: str) -> DataFrame:
    """The pipeline's step: the same function serves a table and a stream."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def batch_layer(df: DataFrame, key: str) -> DataFrame:
    return count_step(df, key)


def speed_layer(df: DataFrame, key: str, ts: str, arrival: str, horizon: int) -> DataFrame:
    """Counts of what is not too far behind when it comes: fast, and short of late events."""
    return count_step(drop_behind(df, ts, arrival, horizon), key)


def drift(batch: DataFrame, speed: DataFrame, key: str) -> DataFrame:
    """(key, batch_n, speed_n, drift): where the two layers differ, and where they do not."""
    both = batch.withColumnRenamed("n", "batch_n").join(speed.withColumnRenamed("n", "speed_n"), key, "full")
    both = both.select(key, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("batch_n", "speed_n")])
    return both.withColumn("drift", F.col("batch_n") - F.col("speed_n"))
