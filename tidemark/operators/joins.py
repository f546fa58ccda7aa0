"""Joins in time: last-touch attribution, as-of and current-value enrichment, joins by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import RUN, running_last


def attribute(clicks: DataFrame, impressions: DataFrame, key: str, ts: str, ident: str, within: int) -> DataFrame:
    """Clicks with their key's latest impression at most `within` before (inclusive), if any.

    (key, ts, ident, impression_ts, impression_id, gap). An impression at a click's own time comes
    before it; a click does not use an impression up. One pass: the streams are united and each click
    looks back, so there is one shuffle and no pair of rows that do not match.
    """
    i = impressions.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.lit(0).alias("kind"), F.col(ident).alias("ident"))
    c = clicks.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.lit(1).alias("kind"), F.col(ident).alias("ident"))
    # Time slices as long as the window: a click's impression is in its own slice or the one before, so a hot key is split.
    cut = F.floor(F.col("ts") / max(within, 1)).cast("long")
    both = i.select("*", F.explode(F.array(cut, cut + 1)).alias("slice"), F.lit(True).alias("copy")).unionByName(c.select("*", cut.alias("slice"), F.lit(False).alias("copy")))
    back = Window.partitionBy("key", "slice").orderBy("ts", "kind", "ident").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("kind") == 0, F.struct("ts", "ident")), ignorenulls=True).over(back)
    found = both.select("*", seen.alias("i")).where("kind = 1")
    gap = F.col("ts") - F.col("i.ts")
    ok = gap <= within
    return found.select(F.col("key").alias(key), F.col("ts").alias(ts), F.col("ident").alias(ident), F.when(ok, F.col("i.ts")).alias("impression_ts"), F.when(ok, F.col("i.ident")).alias("impression_id"), F.when(ok, gap).alias("gap"))


def as_of(facts: DataFrame, versions: DataFrame, ts: str, valid_from: str, value: str, by: list[str] | tuple = (), first_before: bool = True, run: int = RUN) -> DataFrame:
    """Facts with the value of the last version whose valid_from is at most their time.

    first_before: facts older than every version take the first version's value, else null. by: keys
    to match; none means one history for all facts. Scanned in runs of about `run` rows.
    """
    rest = [c for c in facts.columns if c not in by]
    v = versions.select(*by, F.col(valid_from).alias("_t"), F.lit(0).alias("_kind"), F.struct(F.col(value).alias("v")).alias("_version"), F.lit(None).cast(facts.select(F.struct(*rest).alias("r")).schema["r"].dataType).alias("_fact"))
    f = facts.select(*by, F.col(ts).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(v.schema["_version"].dataType).alias("_version"), F.struct(*rest).alias("_fact"))
    joined = running_last(v.unionByName(f), F.col("_version"), ["_t", "_kind"], "_found", by=by, rows=run).where("_kind = 1")
    out = [*by, *[F.col("_fact")[c].alias(c) for c in rest]]
    if not first_before:
        return joined.select(*out, F.col("_found.v").alias(value))
    first = F.min_by(F.struct(F.col(value).alias("v")), valid_from).alias("_first")
    if by:
        joined = joined.join(versions.groupBy(*by).agg(first), [*by], "left")
    else:
        joined = joined.withColumn("_first", versions.agg(first).scalar())
    return joined.select(*out, F.coalesce("_found", "_first")["v"].alias(value))


def current(facts: DataFrame, versions: DataFrame, valid_from: str, value: str, by: list[str] | tuple = ()) -> DataFrame:
    """Facts with the latest version's value, whenever they happened."""
    last = F.max_by(value, valid_from).alias(value)
    if by:
        return facts.join(versions.groupBy(*by).agg(last), [*by], "left")
    return facts.withColumn(value, versions.agg(last).scalar())


def table_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of two tables, each a fold of its changelog."""
    return left.join(right, keys, how)


def side_by_side(left: DataFrame, right: DataFrame, order_left: list, order_right: list, k: int) -> DataFrame:
    """The first k rows of two lists, joined by rank; columns get prefixes l_ and r_."""
    def ranked(df: DataFrame, order: list, prefix: str) -> DataFrame:
        top = df.orderBy(*order).limit(k)
        return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), *[F.col(c).alias(prefix + c) for c in df.columns])

    return ranked(left, order_left, "l_").join(ranked(right, order_right, "r_"), "rank", "full")


def member_flag(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Adds `member`: whether the key is among the members."""
    return df.join(members.select(key).distinct().withColumn("_m", F.lit(True)), key, "left").withColumn("member", F.coalesce("_m", F.lit(False))).drop("_m")
