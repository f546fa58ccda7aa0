"""Counts at a fine grain, and coarser ones from them: never by reading the events again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import truncate


def minute_counts(df: DataFrame, ts: str, dims: list[str]) -> DataFrame:
    return df.groupBy(truncate(F.col(ts), 60).alias("minute"), *dims).agg(F.count("*").alias("n"))


def hour_counts(minutes: DataFrame, dims: list[str]) -> DataFrame:
    """Hours as sums of minutes."""
    return minutes.groupBy(truncate(F.col("minute"), 3600).alias("hour"), *dims).agg(F.sum("n").alias("n"))


def lookup(cube: DataFrame, **cell) -> DataFrame:
    """One row (n): a cell by its full key, 0 if it is absent."""
    for name, value in cell.items():
        cube = cube.where(F.col(name) == F.lit(value))
    return cube.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def slice_sum(cube: DataFrame, keep: list[str]) -> DataFrame:
    """Sums out every dimension but those kept."""
    return cube.groupBy(*keep).agg(F.sum("n").alias("n"))


def grouping_cube(cube: DataFrame, dims: list[str]) -> DataFrame:
    """All subtotals, with grouping_id to tell a subtotal from a null key."""
    return cube.cube(*dims).agg(F.sum("n").alias("n"), F.grouping_id().cast("long").alias("grouping_id"))


def grouping_rollup(cube: DataFrame, dims: list[str]) -> DataFrame:
    return cube.rollup(*dims).agg(F.sum("n").alias("n"), F.grouping_id().cast("long").alias("grouping_id"))


def consistency(df: DataFrame, ts: str, dims: list[str]) -> DataFrame:
    """(hour, *dims, from_minutes, from_events): the two must agree in every cell."""
    ours = hour_counts(minute_counts(df, ts, dims), dims).withColumnRenamed("n", "from_minutes")
    raw = df.groupBy(truncate(F.col(ts), 3600).alias("hour"), *dims).agg(F.count("*").alias("from_events"))
    return ours.join(raw, ["hour", *dims], "full")
