"""The operators as streaming queries."""

from __future__ import annotations

import re
import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or, on one machine only, a temporary one where that is unset."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def replayable(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A file source: its offsets are in the checkpoint, so a restarted query takes up where it was."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(stream: DataFrame, ts: str, size: int, lateness: int, by: list[str] | tuple = (), slide: int | None = None) -> DataFrame:
    """Counts by window. Spark moves the watermark between batches, so what is late depends on how events are batched."""
    timed = stream.withColumn("_at", F.timestamp_seconds(F.col(ts))).withWatermark("_at", f"{lateness} seconds")
    window = F.window("_at", f"{size} seconds", f"{slide or size} seconds").alias("w")
    return timed.groupBy(*by, window).agg(F.count("*").alias("n")).select(*by, F.unix_timestamp("w.start").alias("window_start"), "n")


def session_counts(stream: DataFrame, ts: str, gap: int, lateness: int, by: list[str] | tuple = ()) -> DataFrame:
    timed = stream.withColumn("_at", F.timestamp_seconds(F.col(ts))).withWatermark("_at", f"{lateness} seconds")
    return timed.groupBy(*by, F.session_window("_at", f"{gap} seconds").alias("w")).agg(F.count("*").alias("n")).select(*by, F.unix_timestamp("w.start").alias("session_start"), "n")


def _pairs(clicks: DataFrame, impressions: DataFrame, key: str, ts: str, within: int, lateness: int) -> DataFrame:
    """(c_at, click_id, i_at in seconds, impression_id): all within the window before each click, or none."""
    c = clicks.withColumn("c_at", F.timestamp_seconds(F.col(ts))).withWatermark("c_at", f"{lateness} seconds").withColumnRenamed("id", "click_id").withColumnRenamed(key, "c_key")
    i = impressions.withColumn("i_at", F.timestamp_seconds(F.col(ts))).withWatermark("i_at", f"{lateness} seconds").withColumnRenamed("id", "impression_id").withColumnRenamed(key, "i_key")
    on = F.expr(f"c_key = i_key and i_at <= c_at and c_at <= i_at + interval {within} seconds")
    return c.join(i, on, "leftOuter").select("c_at", "click_id", F.unix_timestamp("i_at").alias("i_at"), "impression_id")


def attributed(clicks: DataFrame, impressions: DataFrame, key: str, ts: str, within: int, lateness: int) -> DataFrame:
    """All impressions within the window before each click, or none: state on both sides is bounded by the watermarks."""
    return _pairs(clicks, impressions, key, ts, within, lateness).select("click_id", "impression_id")


def last_touch(clicks: DataFrame, impressions: DataFrame, key: str, ts: str, within: int, lateness: int) -> DataFrame:
    """(click_id, impression_id): each click with the latest impression within the window before it, or none.

    A click is emitted, once, when the watermark says that no impression before it can come any more;
    impressions are forgotten when no click can use them.
    """
    pairs = _pairs(clicks, impressions, key, ts, within, lateness)
    best = pairs.groupBy("c_at", "click_id").agg(F.max_by("impression_id", F.struct("i_at", "impression_id")).alias("impression_id"))
    return best.select("click_id", "impression_id")


class Ranges:
    """Whole numbers, as ranges in order."""

    def __init__(self, lows: list[int], highs: list[int]):
        self.lows, self.highs = list(lows), list(highs)

    def __contains__(self, x: int) -> bool:
        k = bisect_right(self.lows, x) - 1
        return k >= 0 and x <= self.highs[k]

    def add(self, x: int) -> None:
        if x in self:
            return
        k = bisect_right(self.lows, x)
        left, right = k > 0 and self.highs[k - 1] == x - 1, k < len(self.lows) and self.lows[k] == x + 1
        if left and right:
            self.highs[k - 1] = self.highs.pop(k)
            self.lows.pop(k)
        elif left:
            self.highs[k - 1] = x
        elif right:
            self.lows[k] = x
        else:
            self.lows.insert(k, x)
            self.highs.insert(k, x)


def deduplicated(stream: DataFrame, ts: str, ident: str, lateness: int) -> DataFrame:
    return stream.withColumn("_at", F.timestamp_seconds(F.col(ts))).withWatermark("_at", f"{lateness} seconds").dropDuplicatesWithinWatermark([ident]).drop("_at")


def exact_late_drop(stream: DataFrame, ts: str, arrival: str, size: int, lateness: int, key: str) -> DataFrame:
    """(key, window_start, n): the lateness rule event by event, per key, as windows close.

    State is a key's open windows, its greatest time and the windows that are closed, all of them, as
    ranges (a key without gaps has one). Rows of a batch are taken in order of arrival.
    """
    def step(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        most, starts, counts, lows, highs = state.get if state.exists else (None, [], [], [], [])
        opened, gone, out = dict(zip(starts, counts)), Ranges(lows, highs), []
        for row in pd.concat(list(parts)).sort_values(arrival).itertuples(index=False):
            at = int(getattr(row, ts))
            start = at // size * size
            if at // size in gone:
                continue
            opened[start] = opened.get(start, 0) + 1
            most = at if most is None else max(most, at)
            for s in sorted(opened):
                if most - lateness >= s + size:
                    out.append((keys[0], s, opened.pop(s)))
                    gone.add(s // size)
        state.update((most, list(opened), list(opened.values()), gone.lows, gone.highs))
        yield pd.DataFrame(out, columns=["key", "window_start", "n"])

    grouped = stream.select(F.col(key).cast("string").alias("key"), ts, arrival).groupBy("key")
    return grouped.applyInPandasWithState(step, "key string, window_start long, n long", "most long, starts array<long>, counts array<long>, lows array<long>, highs array<long>", "append", "NoTimeout")


def run_to_end(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, name: str | None = None, mode: str = "append") -> StreamingQuery:
    """Runs a query over all that its sources hold, into a function of each batch or a table in memory."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_with_restarts(make: Callable[[], DataFrame], checkpoint: str, sink: Callable[[DataFrame, int], None], restarts: int = 3, mode: str = "append") -> int:
    """Starts a query anew on its checkpoint as often as it fails, up to a number of times; returns the failures."""
    for failures in range(restarts + 1):
        try:
            run_to_end(make(), checkpoint, sink, mode=mode)
            return failures
        except Exception:
            if failures == restarts:
                raise
    return restarts
