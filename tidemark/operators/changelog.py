"""Tables from changelogs and back: folding, compaction, change capture and replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import lagged


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key. A max over structs, combined before the shuffle: a hot key is no bottleneck."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def fold(log: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The table a changelog describes: the last value of each key, keys whose last value is null left out."""
    return latest(log, keys, order).where(F.col(value).isNotNull()).select(*keys, value)


def compact(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key, tombstones kept."""
    return latest(log, keys, order)


def capture(writes: DataFrame, keys: list[str], op: str, value: str, order: str) -> DataFrame:
    """Adds `before` and `after` to writes (op c, u or d): what a key held, and holds. Ops are not validated."""
    after = F.when(F.col(op) == "d", F.lit(None)).otherwise(F.col(value))
    return lagged(writes.withColumn("after", after), F.col("after"), [order], "before", keys)


def replicate(changes: DataFrame, keys: list[str], op: str, order: str) -> DataFrame:
    """The table that captured changes lead to."""
    return latest(changes, keys, order).where(F.col(op) != "d").select(*keys, F.col("after").alias("value"))


def snapshot_changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, op, before, after): the changes between two snapshots of a table."""
    a = old.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_old"))
    b = new.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_new"))
    both = a.join(b, keys, "full")
    op = F.when(F.col("_old").isNull(), "c").when(F.col("_new").isNull(), "d").when(~F.col("before").eqNullSafe(F.col("after")), "u")
    return both.select(*keys, op.alias("op"), "before", "after").where("op is not null")


def tables_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (equal): whether two tables hold the same rows, each as often."""
    right = right.select(*left.columns)
    counted: list[Column] = [F.sum("_a").alias("a"), F.sum("_b").alias("b")]
    both = left.withColumns({"_a": F.lit(1), "_b": F.lit(0)}).unionByName(right.withColumns({"_a": F.lit(0), "_b": F.lit(1)}))
    return both.groupBy(*left.columns).agg(*counted).agg(F.coalesce(F.sum((F.col("a") != F.col("b")).cast("int")), F.lit(0)).alias("x")).select((F.col("x") == 0).alias("equal"))
