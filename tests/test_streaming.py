import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import unified
from tidemark.streaming import sinks, streams

KEYS = ["US", "IN", "US", "UK", "US", "IN", "US", "UK", "US", "IN"]


@pytest.fixture
def log(spark, tmp_path):
    """Ten events in ten files, so that a batch of two files is two events."""
    folder = str(tmp_path / "log")
    for i, key in enumerate(KEYS):
        spark.createDataFrame([(i, f"ev{i}", key)], "offset long, id string, key string").coalesce(1).write.mode("append").parquet(folder)
    return folder


SCHEMA = "offset long, id string, key string"


@pytest.mark.parametrize("crash, counter, upsert", [(None, 10, 10), (2, 12, 10)])
def test_sinks_after_a_crash(spark, log, tmp_path, crash, counter, upsert):
    make = lambda: streams.replayable(spark, log, SCHEMA, 2)
    blind = sinks.CounterSink(str(tmp_path / "blind"), sinks.CrashOnce(crash))
    keyed = sinks.UpsertSink(str(tmp_path / "keyed"), "id", sinks.CrashOnce(crash))
    whole = sinks.TransactionalSink(str(tmp_path / "whole"), sinks.CrashOnce(crash))
    for n, sink in enumerate((blind, keyed, whole)):
        assert streams.run_with_restarts(make, str(tmp_path / f"check{n}"), sink) == (crash is not None)
    assert (blind.total(spark), keyed.total(spark), whole.total(spark)) == (counter, upsert, upsert)


def test_state_recovers_after_a_crash(spark, log, tmp_path):
    seen = {}
    crash = sinks.CrashOnce(2)

    def keep(df, batch_id):
        seen.update({r.key: r.n for r in df.collect()})
        crash(batch_id)

    def make():
        return unified.count_step(streams.replayable(spark, log, SCHEMA, 2), "key")

    for _ in range(2):
        try:
            streams.run_to_end(make(), str(tmp_path / "check"), keep, mode="update")
        except Exception:
            continue
    assert seen == {"US": 5, "IN": 3, "UK": 2}


def write(spark, folder, rows, schema):
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_stream_equals_batch(spark, log, tmp_path):
    streams.run_to_end(unified.count_step(streams.replayable(spark, log, SCHEMA), "key"), str(tmp_path / "c"), name="counts", mode="complete")
    batch = unified.count_step(spark.read.parquet(log), "key")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_windowed_counts_emit_closed_windows(spark, tmp_path):
    folder = write(spark, str(tmp_path / "in"), [(t,) for t in (2, 5, 9, 12, 19, 31, 60)], "t long")
    streams.run_to_end(streams.windowed_counts(streams.replayable(spark, folder, "t long"), "t", 10, 2), str(tmp_path / "c"), name="windows")
    assert sorted(map(tuple, spark.table("windows").collect())) == [(0, 3), (10, 2), (30, 1)]


def test_exact_late_drop_follows_each_event(spark, tmp_path):
    times = [2, 5, 9, 7, 12, 8, 15, 19]
    folder = str(tmp_path / "in")
    spark.createDataFrame([(i, t, "k") for i, t in enumerate(times)], "seq long, t long, k string").coalesce(1).write.parquet(folder)
    stream = streams.replayable(spark, folder, "seq long, t long, k string")
    streams.run_to_end(streams.exact_late_drop(stream, "t", "seq", 10, 2, "k"), str(tmp_path / "c"), name="exact")
    assert [tuple(r) for r in spark.table("exact").collect()] == [("k", 0, 4)]


def test_closed_windows_are_never_opened_again(spark, tmp_path):
    """However far behind an event is, and over batches: against a loop."""
    times = [2, 13, 5_000, 4, 5_013, 90_000, 3, 14, 5_001, 47, 90_030]
    folder = str(tmp_path / "in")
    for i, t in enumerate(times):
        spark.createDataFrame([(i, t, "k")], "seq long, t long, k string").coalesce(1).write.mode("append").parquet(folder)
    most, opened, closed, want = None, {}, set(), []
    for t in times:
        s = t // 10 * 10
        if s in closed:
            continue
        opened[s] = opened.get(s, 0) + 1
        most = t if most is None else max(most, t)
        for w in sorted(opened):
            if most - 2 >= w + 10:
                want.append(("k", w, opened.pop(w)))
                closed.add(w)
    stream = streams.replayable(spark, folder, "seq long, t long, k string", 2)
    streams.run_to_end(streams.exact_late_drop(stream, "t", "seq", 10, 2, "k"), str(tmp_path / "c"), name="closed")
    assert sorted(tuple(r) for r in spark.table("closed").collect()) == sorted(want)


def test_ranges_hold_what_a_set_holds():
    rng = random.Random(2)
    for _ in range(50):
        ranges, held = streams.Ranges([], []), set()
        for _ in range(40):
            x = rng.randint(-15, 15)
            ranges.add(x)
            held.add(x)
        assert [x in ranges for x in range(-20, 20)] == [x in held for x in range(-20, 20)]
        assert all(a + 1 < b for a, b in zip(ranges.highs, ranges.lows[1:]))


def test_console(spark, log, tmp_path):
    sinks.console(streams.replayable(spark, log, SCHEMA), str(tmp_path / "c"))


def test_attribution_and_dedup_streams(spark, tmp_path):
    i = write(spark, str(tmp_path / "i"), [(10, "A", "imp-A"), (12, "B", "imp-B"), (500, "Z", "imp-Z"), (600, "Z", "imp-Y")], "t long, ad string, id string")
    c = write(spark, str(tmp_path / "c"), [(25, "A", "clk-A"), (50, "B", "clk-B"), (500, "Y", "clk-Y"), (600, "Y", "clk-X")], "t long, ad string, id string")
    schema = "t long, ad string, id string"
    streams.run_to_end(streams.attributed(streams.replayable(spark, c, schema), streams.replayable(spark, i, schema), "ad", "t", 30, 5), str(tmp_path / "check"), name="pairs")
    found = {r.click_id: r.impression_id for r in spark.table("pairs").collect()}
    assert found["clk-A"] == "imp-A" and found["clk-B"] is None
    d = write(spark, str(tmp_path / "d"), [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b")], "t long, id string")
    streams.run_to_end(streams.deduplicated(streams.replayable(spark, d, "t long, id string"), "t", "id", 100), str(tmp_path / "cd"), name="unique")
    assert sorted(r.id for r in spark.table("unique").select(F.col("id")).collect()) == ["a", "b", "c"]
