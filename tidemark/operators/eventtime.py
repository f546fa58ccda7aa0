"""Event time with late data, exactly as one event after another would see it.

`arrival` numbers events as they arrive. A running maximum over arrivals tells how far event time had
come; it is taken in runs of arrivals (see scan), not in one partition. run: arrivals of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import RUN, running_max
from .windows import truncate


def watermark(df: DataFrame, ts: str, arrival: str, lateness: int, run: int = RUN) -> DataFrame:
    """Adds `watermark`, as it stands before each event: the greatest time so far, less the lateness; null at first."""
    scanned = running_max(df, F.col(ts), [arrival, ts], "_seen", inclusive=False, rows=run)
    return scanned.withColumn("watermark", F.col("_seen") - lateness).drop("_seen")


def mark_late(df: DataFrame, ts: str, arrival: str, size: int, lateness: int, run: int = RUN) -> DataFrame:
    """Adds `window_start`, `watermark` and `late`: the event's window had closed when it came.

    A window that has had no event is not closed, so its first event is always taken. A late event
    cannot raise the maximum, as its time lies below a window end that the watermark has passed.
    """
    marked = watermark(df.withColumn("window_start", truncate(F.col(ts), size)), ts, arrival, lateness, run)
    first = marked.groupBy("window_start").agg(F.min(F.struct(arrival, ts)).alias("_first"))
    marked = marked.join(first, "window_start")
    after_first = F.struct(arrival, ts) > F.col("_first")
    closed = F.coalesce(F.col("watermark") >= F.col("window_start") + size, F.lit(False))
    return marked.withColumn("late", after_first & closed).drop("_first")


def late_drop_windows(df: DataFrame, ts: str, arrival: str, event_id: str | None, size: int, lateness: int, run: int = RUN) -> DataFrame:
    """(window_start, window_end, n, ids, closed): accepted events of each window, ids in order of arrival.

    The ids of a window are one value; without event_id they are left out, and windows may be of any size.

    closed: whether the watermark passed the window's end before the input ended. Only closed windows
    are emitted by the rule; open ones are returned too, so that callers can tell.
    """
    marked = mark_late(df, ts, arrival, size, lateness, run)
    found = [] if event_id is None else [F.array_sort(F.collect_list(F.struct(F.col(arrival).alias("a"), F.col(event_id).alias("id")))).alias("_ids")]
    taken = marked.where(~F.col("late")).groupBy("window_start").agg(F.count("*").alias("n"), *found)
    final = df.agg(F.max(ts) - lateness).scalar()
    ids = [F.transform("_ids", lambda x: x["id"]).alias("ids")] if found else []
    return taken.select("window_start", (F.col("window_start") + size).alias("window_end"), "n", *ids, (final >= F.col("window_start") + size).alias("closed"))


def late_events(df: DataFrame, ts: str, arrival: str, size: int, lateness: int, run: int = RUN) -> DataFrame:
    """Side output: the events that late_drop_windows leaves out."""
    return mark_late(df, ts, arrival, size, lateness, run).where("late").drop("late")


def drop_behind(df: DataFrame, ts: str, arrival: str, horizon: int, run: int = RUN) -> DataFrame:
    """Events not further behind the greatest time seen, their own included, than the horizon."""
    scanned = running_max(df, F.col(ts), [arrival, ts], "_seen", rows=run)
    return scanned.where(F.col(ts) >= F.col("_seen") - horizon).drop("_seen")
