"""Credit-based flow control in virtual time, as a fold over ticks.

A source log, then buffers map, window and sink. In a tick the log grows, the sink drains, and each
stage, from the last to the first, takes what its rate, its upstream and the room downstream allow.
On a real stream the same brake is the source's rate limit (maxOffsetsPerTrigger, maxFilesPerTrigger).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "struct<t:bigint,produced:bigint,consumed:bigint,map:bigint,win:bigint,sink:bigint,written:bigint,throttled:boolean>"


def simulate(spark: SparkSession, ticks: int, capacity: int = 6, rate: int = 6, produce: int = 3, slow: int = 1, fast: int = 6, slow_ticks: int = 12, credit: bool = True) -> DataFrame:
    """(t, produced, consumed, map, win, sink, written, throttled, lag, memory): one row per tick.

    With credit off the source reads what there is, whatever the room, and only one buffer is kept.
    """
    step = f"""
      named_struct('drain', least(s.sink, if(t <= {slow_ticks}, {slow}, {fast})), 's', s)
    """
    if credit:
        body = f"""
        transform(array({step}), d -> transform(array(named_struct('w2s', least({rate}L, d.s.win, {capacity} - (d.s.sink - d.drain)), 'd', d)), a ->
          transform(array(named_struct('m2w', least({rate}L, a.d.s.map, {capacity} - (a.d.s.win - a.w2s)), 'a', a)), b ->
            transform(array(named_struct('avail', b.a.d.s.produced + {produce} - b.a.d.s.consumed, 'room', {capacity} - (b.a.d.s.map - b.m2w), 'b', b)), c ->
              named_struct('t', t, 'produced', c.b.a.d.s.produced + {produce}, 'consumed', c.b.a.d.s.consumed + least({rate}L, c.avail, c.room),
                'map', c.b.a.d.s.map - c.b.m2w + least({rate}L, c.avail, c.room), 'win', c.b.a.d.s.win - c.b.a.w2s + c.b.m2w,
                'sink', c.b.a.d.s.sink - c.b.a.d.drain + c.b.a.w2s, 'written', c.b.a.d.s.written + c.b.a.d.drain,
                'throttled', least({rate}L, c.avail, c.room) < least({rate}L, c.avail)))[0])[0])[0])[0]
        """
    else:
        body = f"""
        transform(array({step}), d -> named_struct('t', t, 'produced', d.s.produced + {produce},
          'consumed', d.s.consumed + least({rate}L, d.s.produced + {produce} - d.s.consumed), 'map', 0L, 'win', 0L,
          'sink', d.s.sink - d.drain + least({rate}L, d.s.produced + {produce} - d.s.consumed), 'written', d.s.written + d.drain, 'throttled', false))[0]
        """
    start = f"cast(named_struct('t', 0L, 'produced', 0L, 'consumed', 0L, 'map', 0L, 'win', 0L, 'sink', 0L, 'written', 0L, 'throttled', false) as {STATE})"
    history = f"""aggregate(sequence(1L, {ticks}L), array({start}), (h, t) ->
        concat(h, transform(array(element_at(h, -1)), s -> cast({body} as {STATE}))))"""
    rows = spark.range(1).select(F.explode(F.expr(f"slice({history}, 2, {ticks})")).alias("s")).select("s.*")
    return rows.select("*", (F.col("produced") - F.col("consumed")).alias("lag"), (F.col("map") + F.col("win") + F.col("sink")).alias("memory"))


def bottleneck(states: DataFrame, capacity: int = 6) -> DataFrame:
    """(t, stage): the deepest full stage whose downstream is not full; null if no stage is full."""
    full = [F.col(c) >= capacity for c in ("sink", "win", "map")]
    stage = F.when(full[0], "SINK").when(full[1] & ~full[0], "WINDOW").when(full[2] & ~full[1], "MAP")
    return states.select("t", stage.alias("stage"))


def filled_at(states: DataFrame, capacity: int = 6) -> DataFrame:
    """One row: the tick at which each buffer was first full, and the source first throttled."""
    when = lambda c: F.min(F.when(c, F.col("t")))
    return states.agg(when(F.col("sink") >= capacity).alias("sink_full"), when(F.col("win") >= capacity).alias("window_full"), when(F.col("map") >= capacity).alias("map_full"), when(F.col("throttled")).alias("throttled_at"))
