"""Reading tables, and event time as whole seconds whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def with_times(df: DataFrame) -> DataFrame:
    """Adds `t`, the time in seconds, and `seq`, a derived order of arrival in which some events are late."""
    return df.withColumn("t", seconds(F.col("ts"))).withColumn("seq", (F.col("event_id") + F.col("event_id") * 7919 % 23) * 1_000_000_000 + F.col("event_id") % 1_000_000_000)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return with_times(table(spark, folder, "events"))
