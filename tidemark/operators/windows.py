"""Tumbling, sliding and session windows over event time in whole seconds. Windows are half-open: [start, end)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import lagged

#: Windows of a spine that are made in one place.
PART = 4096


def truncate(ts: Column, grain: int) -> Column:
    """Start of the grain that a time falls in."""
    return F.floor(ts / F.lit(grain)).cast("long") * grain


def in_window(ts: Column, start: Column | int, size: int) -> Column:
    return (ts >= start) & (ts < start + size)


def tumbling(df: DataFrame, ts: str, size: int, by: list[str] | tuple = (), aggregates: list[Column] | None = None) -> DataFrame:
    """(*by, window_start, n): only windows that have events."""
    return df.groupBy(*by, truncate(F.col(ts), size).alias("window_start")).agg(*(aggregates or [F.count("*").alias("n")]))


def sliding(df: DataFrame, ts: str, size: int, slide: int, by: list[str] | tuple = (), anchor: int = 0) -> DataFrame:
    """(*by, window_start, n): every window from the anchor to the last event's, those without events too.

    Windows start at anchor + k * slide and none before the anchor. Events are counted by pane (the
    greatest common divisor of size and slide) first, and panes, not events, go to the windows that
    hold them; the spine of all windows is made in parts, from one row of bounds for each key.
    """
    grain = math.gcd(size, slide)
    panes = df.where(F.col(ts) >= anchor).groupBy(*by, (anchor + F.floor((F.col(ts) - anchor) / grain).cast("long") * grain).alias("_ts")).agg(F.count("*").alias("_n"))
    last = F.floor((F.col("_ts") - anchor) / slide).cast("long")
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_ts") - anchor - size) / slide).cast("long") + 1)
    hits = panes.select(*by, F.explode(F.sequence(first, F.greatest(first, last))).alias("k"), "_ts", "_n")
    hits = hits.where((F.col("_ts") >= anchor + F.col("k") * slide) & (F.col("_ts") < anchor + F.col("k") * slide + size))
    counts = hits.groupBy(*by, "k").agg(F.sum("_n").alias("n"))
    spine = df.groupBy(*by).agg(F.max(ts).alias("_last")).where(F.col("_last") >= anchor)
    spine = spine.select(*by, F.floor((F.col("_last") - anchor) / slide).cast("long").alias("_end"))
    spine = spine.select(*by, "_end", F.explode(F.expr(f"sequence(0L, _end div {PART})")).alias("_part")).repartition(*by, "_part")
    spine = spine.select(*by, F.explode(F.expr(f"sequence(_part * {PART}, least(_end, (_part + 1) * {PART} - 1))")).alias("k"))
    return spine.join(counts, [*by, "k"], "left").select(*by, (anchor + F.col("k") * slide).alias("window_start"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def sessions(df: DataFrame, ts: str, gap: int, by: list[str] | tuple = ()) -> DataFrame:
    """(*by, session_start, session_end, n): a new session begins when more than `gap` passes since the event before.

    session_window closes a session at gap after its last event, and joins events exactly gap apart.
    It merges sessions that partitions begin before it shuffles them, so a busy key is no bottleneck.
    """
    stamped = df.withColumn("_at", F.timestamp_seconds(F.col(ts)))
    grouped = stamped.groupBy(*by, F.session_window("_at", f"{gap} seconds").alias("_s")).agg(F.count("*").alias("n"), F.min(ts).alias("session_start"), F.max(ts).alias("session_end"))
    return grouped.select(*by, "session_start", "session_end", "n")


def lag_gap(df: DataFrame, ts: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds `gap`: the time since the key's event before."""
    return lagged(df, F.col(ts), order, "_before", by).withColumn("gap", F.col(ts) - F.col("_before")).drop("_before")
