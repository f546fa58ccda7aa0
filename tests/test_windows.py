"""Windows, event time and rollups on small inputs whose results are worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import eventtime, rollup, scan, windows

CLICKS = [(2, "a"), (5, "b"), (8, "a"), (12, "c"), (18, "b"), (21, "a"), (24, "d"), (29, "b"), (33, "a")]
ARRIVALS = [("e1", 2), ("e2", 5), ("e3", 9), ("e4", 7), ("e5", 12), ("e6", 8), ("e7", 15), ("e8", 19)]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def clicks(spark):
    return spark.createDataFrame(CLICKS, "ts long, user string")


def test_tumbling(clicks):
    assert rows(windows.tumbling(clicks, "ts", 10)) == [(0, 3), (10, 2), (20, 3), (30, 1)]


def test_sliding_has_empty_windows_and_no_negative_start(spark, clicks):
    assert rows(windows.sliding(clicks, "ts", 10, 5)) == [(0, 3), (5, 3), (10, 2), (15, 3), (20, 3), (25, 2), (30, 1)]
    gap = spark.createDataFrame([(1,), (31,)], "ts long")
    assert rows(windows.sliding(gap, "ts", 10, 10)) == [(0, 1), (10, 0), (20, 0), (30, 1)]
    assert rows(windows.sliding(gap.where("ts < 0"), "ts", 10, 10)) == []


def test_sliding_with_slide_beyond_size(spark):
    df = spark.createDataFrame([(0,), (7,), (12,)], "ts long")
    assert rows(windows.sliding(df, "ts", 5, 10)) == [(0, 1), (10, 1)]


def test_sessions_join_at_exactly_the_gap(clicks):
    assert rows(windows.sessions(clicks, "ts", 4)) == [(2, 12, 4), (18, 24, 3), (29, 33, 2)]


def test_session_boundary(spark):
    df = spark.createDataFrame([(0,), (4,), (9,)], "ts long")
    assert rows(windows.sessions(df, "ts", 4)) == [(0, 4, 2), (9, 9, 1)]


def test_late_drop_on_the_fixture(spark):
    df = spark.createDataFrame([(i, t, e) for i, (e, t) in enumerate(ARRIVALS)], "seq long, t long, id string")
    out = eventtime.late_drop_windows(df, "t", "seq", "id", 10, 2)
    assert sorted((r.window_start, r.n, tuple(r.ids), r.closed) for r in out.collect()) == [(0, 4, ("e1", "e2", "e3", "e4"), True), (10, 3, ("e5", "e7", "e8"), False)]
    assert [r.id for r in eventtime.late_events(df, "t", "seq", 10, 2).collect()] == ["e6"]


@pytest.mark.parametrize("run", [1, 7, 8192])
def test_late_marks_equal_a_loop(spark, run):
    rng = random.Random(run)
    data = [(i, max(0, i + rng.randint(-40, 5))) for i in range(400)]
    most, seen, closed, late = None, set(), set(), set()
    for i, t in data:
        start = t // 10 * 10
        if start in closed:
            late.add(i)
            continue
        seen.add(start)
        most = t if most is None else max(most, t)
        closed |= {s for s in seen if most - 3 >= s + 10}
    df = spark.createDataFrame(data, "seq long, t long")
    assert {r.seq for r in eventtime.mark_late(df, "t", "seq", 10, 3, run).where("late").collect()} == late


def test_drop_behind_counts_the_event_itself(spark):
    log = [("alice", 1), ("bob", 2), ("alice", 4), ("bob", 6), ("alice", 3), ("alice", 8)]
    df = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(log)], "seq long, user string, t long")
    assert [(r.user, r.t) for r in eventtime.drop_behind(df, "t", "seq", 2).orderBy("seq").collect()] == [("alice", 1), ("bob", 2), ("alice", 4), ("bob", 6), ("alice", 8)]


def test_running_last_skips_nulls_across_runs(spark):
    df = spark.createDataFrame([(0, None), (1, "a"), (2, None), (3, None), (4, "b"), (5, None)], "i long, v string")
    out = scan.running_last(df, F.col("v"), ["i"], "last", rows=2)
    assert [r["last"] for r in out.orderBy("i").collect()] == [None, "a", "a", "a", "b", "b"]


def test_runs_are_cut_from_the_data(spark):
    """Whatever the values are, runs are about equal and far fewer than rows."""
    for value in (F.col("id") * 1_000_000_000, F.pow(F.lit(1.0005), F.col("id")), F.when(F.col("id") < 9_000, F.col("id") % 3).otherwise(F.col("id"))):
        df = spark.range(20_000).select(value.alias("at"), "id")
        got = df.select("at", scan.runs(df, "at", 500).alias("run"))
        sizes = [r["count"] for r in got.groupBy("run").count().collect()]
        assert 5 <= len(sizes) <= 40 and max(sizes) <= 3_600
        ends = sorted((r.lo, r.hi, r.run) for r in got.groupBy("run").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).collect())
        assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(ends, ends[1:]))


def test_running_scans_equal_loops(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("aaaab"), rng.choice([None, rng.randint(0, 99)])) for i in range(300)]
    df = spark.createDataFrame(data, "i long, k string, _v long").repartition(5)
    count, last, seen = {}, {}, {}
    for i, k, v in data:
        seen[k] = seen.get(k, 0) + 1
        count[i], last_of = seen[k], last.setdefault(k, [])
        last_of.append((i, v))
    lag = {i: before for rows in last.values() for (i, _), before in zip(rows, [None, *[v for _, v in rows]])}
    assert {r.i: r.n for r in scan.running_count(df, "i", "n", ["k"], rows=7).collect()} == count
    got = scan.lagged(df, F.col("_v"), ["i"], "before", ["k"], rows=7)
    assert {r.i: r.before for r in got.collect()} == lag and got.columns == ["i", "k", "_v", "before"]


def test_rollups(spark):
    df = spark.createDataFrame([(0, "US"), (59, "US"), (60, "IN"), (3599, "US"), (3600, "IN")], "ts long, country string")
    minutes = rollup.minute_counts(df, "ts", ["country"])
    hours = rollup.hour_counts(minutes, ["country"])
    assert rows(minutes) == [(0, "US", 2), (60, "IN", 1), (3540, "US", 1), (3600, "IN", 1)]
    assert rows(hours) == [(0, "IN", 1), (0, "US", 3), (3600, "IN", 1)]
    assert rollup.lookup(hours, hour=0, country="US").first().n == 3 and rollup.lookup(hours, hour=0, country="UK").first().n == 0
    assert rows(rollup.slice_sum(hours, ["hour"])) == [(0, 4), (3600, 1)]
    assert rollup.consistency(df, "ts", ["country"]).where("from_minutes <> from_events or from_minutes is null or from_events is null").isEmpty()
    assert rollup.grouping_cube(hours, ["hour", "country"]).where("grouping_id = 3").first().n == 5
