"""Deterministic test data, made where it is used: ranges and seeded hashes, no driver-side rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash32


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows with `seq`, their place of arrival."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"seq long, {schema}")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a row's key and a seed: the same in every run and partitioning."""
    return hash32(key.cast("string"), seed) / F.lit(float(1 << 32))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """The rows in an order that does not depend on how they lie."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def skewed_tags(spark: SparkSession, hot: tuple = (("#harvest", 50_000), ("#regatta", 30_000), ("#chess", 12_000), ("#lantern", 8_000)), tail: int = 50_000, tail_rows: int = 200_000) -> DataFrame:
    """(tag): a few hot tags and a long tail."""
    parts = [spark.range(n).select(F.lit(tag).alias("tag")) for tag, n in hot]
    parts.append(spark.range(tail_rows).select(F.concat(F.lit("#tag"), (F.col("id") % tail).cast("string")).alias("tag")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def repeated_users(spark: SparkSession, rows: int = 1_000_000, users: int = 200_000) -> DataFrame:
    return spark.range(rows).select(F.concat(F.lit("user:"), (F.col("id") % users).cast("string")).alias("user"))


def prefixed_ids(spark: SparkSession, prefix: str, n: int) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit(prefix + ":"), F.col("id").cast("string")).alias("id"))


def page_views(spark: SparkSession, rows: int = 20_000, seconds: int = 7_200, countries: tuple = ("DE", "DE", "DE", "FR", "FR", "ES"), seed: int = 11) -> DataFrame:
    """(ts, country): times over the span, countries by how often they are listed."""
    pick = F.floor(uniform(F.col("id"), seed + 1) * len(countries)).cast("int") + 1
    return spark.range(rows).select(F.floor(uniform(F.col("id"), seed) * seconds).cast("long").alias("ts"), F.element_at(F.array(*map(F.lit, countries)), pick).alias("country"))


def zipf_plays(spark: SparkSession, plays: int = 50_000, songs: int = 2_000, users: int = 5_000, seconds: int = 10_800, seed: int = 7) -> DataFrame:
    """(ts, user, song): songs with weight 1 / rank, drawn through the cumulative weights.

    The draw meets the weights by bucket of the unit interval, so it is an equi-join, not a scan of all songs.
    """
    cells = max(1, songs)
    weights = spark.range(1, songs + 1).select(F.col("id").alias("rank"), (1 / F.col("id")).alias("w"))
    upper = F.sum("w").over(Window.orderBy("rank")) / F.sum("w").over(Window.partitionBy())
    bounds = weights.select("rank", upper.alias("hi"))
    bounds = bounds.select("rank", F.coalesce(F.lag("hi").over(Window.orderBy("rank")), F.lit(0.0)).alias("lo"), F.when(F.col("rank") == songs, 1.0).otherwise(F.col("hi")).alias("hi"))
    bounds = bounds.select("*", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))).alias("cell"))
    drawn = spark.range(plays).select("id", uniform(F.col("id"), seed).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") * cells))
    met = drawn.join(bounds, "cell").where("u >= lo and u < hi")
    number = F.lpad(F.col("rank").cast("string"), 4, "0")
    return met.select(F.floor(uniform(F.col("id"), seed + 1) * seconds).cast("long").alias("ts"), F.concat(F.lit("user-"), F.floor(uniform(F.col("id"), seed + 2) * users).cast("string")).alias("user"), F.concat(F.lit("song-"), number).alias("song"))


def rate_log(spark: SparkSession, ticks: int, per_tick: int) -> DataFrame:
    """(offset, tick): a log that a producer appends to, whatever its readers do."""
    return spark.range(ticks * per_tick).select(F.col("id").alias("offset"), F.floor(F.col("id") / per_tick).cast("long").alias("tick"))
