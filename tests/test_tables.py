"""Changelogs, joins, top-K, flow control, schemas and the two designs, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changelog, flow, joins, registry, topk, unified
from tidemark.plans.queries import REQUIRED, RENAMED, V1, V2, V3
from tidemark.sources import generators

LOG = [("alice", 100), ("bob", 50), ("alice", 140), ("carol", 30), ("bob", 20), ("alice", 175), ("carol", 30)]
WRITES = [("c", "x9001", 100), ("c", "x9002", 250), ("u", "x9001", 175), ("c", "x9003", 60), ("d", "x9002", None), ("u", "x9003", 90)]
USERS = [("alice", 1), ("bob", 2), ("alice", 4), ("bob", 6), ("alice", 3), ("alice", 8)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_fold_and_compaction(spark):
    log = generators.literal(spark, LOG, "key string, value long")
    assert rows(changelog.fold(log, ["key"], "value", "seq")) == [("alice", 175), ("bob", 20), ("carol", 30)]
    gone = generators.literal(spark, [*LOG, ("bob", None)], "key string, value long")
    assert rows(changelog.fold(gone, ["key"], "value", "seq")) == [("alice", 175), ("carol", 30)]
    compacted = changelog.compact(gone, ["key"], "seq")
    assert ("bob", None) in [(r.key, r.value) for r in compacted.collect()]
    assert changelog.tables_equal(changelog.fold(gone, ["key"], "value", "seq"), changelog.fold(compacted, ["key"], "value", "seq")).first().equal


def test_capture_and_replica(spark):
    changes = changelog.capture(generators.literal(spark, WRITES, "op string, key string, value long"), ["key"], "op", "value", "seq")
    assert [r.before for r in changes.orderBy("seq").collect()] == [None, None, 100, None, 250, 60]
    assert rows(changelog.replicate(changes, ["key"], "op", "seq")) == [("x9001", 175), ("x9003", 90)]


def test_snapshot_changes(spark):
    old, new = (spark.createDataFrame(x, "k string, v long") for x in ([("a", 1), ("b", 2), ("c", 3)], [("a", 1), ("b", 5), ("d", 4)]))
    assert rows(changelog.snapshot_changes(old, new, ["k"], "v")) == [("b", "u", 2, 5), ("c", "d", 3, None), ("d", "c", None, 4)]


def test_tables_equal_counts_repeats(spark):
    one, two = (spark.createDataFrame(x, "k string") for x in ([("a",), ("a",)], [("a",)]))
    assert changelog.tables_equal(one, one).first().equal and not changelog.tables_equal(one, two).first().equal


def test_attribution(spark):
    impressions = spark.createDataFrame([(10, "A", "imp-A"), (12, "B", "imp-B")], "t long, ad string, id string")
    clicks = spark.createDataFrame([(25, "A", "clk-A"), (50, "B", "clk-B")], "t long, ad string, id string")
    out = {r.id: (r.impression_id, r.gap) for r in joins.attribute(clicks, impressions, "ad", "t", "id", 30).collect()}
    assert out == {"clk-A": ("imp-A", 15), "clk-B": (None, None)}


def test_attribution_edges(spark):
    impressions = spark.createDataFrame([(0, "A", "i0"), (5, "A", "i1"), (30, "A", "i2")], "t long, ad string, id string")
    clicks = spark.createDataFrame([(30, "A", "at"), (60, "A", "edge"), (61, "A", "past"), (1, "B", "other")], "t long, ad string, id string")
    out = {r.id: r.impression_id for r in joins.attribute(clicks, impressions, "ad", "t", "id", 30).collect()}
    assert out == {"at": "i2", "edge": "i2", "past": None, "other": None}


@pytest.mark.parametrize("run", [1, 15, 8_192])
def test_as_of_and_current(spark, run):
    prices = spark.createDataFrame([(0, 100), (20, 120), (40, 150)], "valid_from long, price long")
    orders = spark.createDataFrame([(5, "P1", 2, "ord-1"), (25, "P1", 1, "ord-2"), (-3, "P1", 1, "early")], "t long, product string, qty long, id string")
    out = {r.id: r.price * r.qty for r in joins.as_of(orders, prices, "t", "valid_from", "price", run=run).collect()}
    assert out == {"ord-1": 200, "ord-2": 120, "early": 100}
    assert {r.id: r.price for r in joins.as_of(orders, prices, "t", "valid_from", "price", first_before=False, run=run).collect()}["early"] is None
    assert {r.id: r.price * r.qty for r in joins.current(orders, prices, "valid_from", "price").collect()} == {"ord-1": 300, "ord-2": 150, "early": 150}


def test_topk(spark):
    plays = generators.zipf_plays(spark, 3_000, 50, 100).withColumn("win", F.floor(F.col("ts") / 3_600)).withColumn("shard", topk.shard_of("user", 2))
    assert plays.count() == 3_000
    hourly, daily = topk.fast_path(plays, "win", "shard", "song", 3, 10)
    exact = plays.groupBy("song").count().orderBy(F.desc("count"), "song").limit(3)
    assert [r.song for r in daily.orderBy("rank").collect()] == [r.song for r in exact.collect()]
    assert hourly.groupBy("win").count().where("count <> 3").isEmpty()
    held = topk.heap_in_order(plays.withColumn("n", F.monotonically_increasing_id()), ["win", "shard"], "song", "n", 50)
    truth = plays.groupBy("win", "shard", "song").count()
    assert rows(held) == rows(truth)  # room for all


def test_heap_replaces_only_if_strictly_greater():
    heap = topk.Heap(2)
    for item, estimate in [("a", 1), ("b", 1), ("c", 1), ("a", 2), ("d", 2)]:
        heap.offer(item, estimate)
    assert heap.held == {"a": 2, "d": 2}


def test_flow(spark):
    states = flow.simulate(spark, 19)
    by = {r.t: r for r in states.collect()}
    assert (by[12].lag, by[12].memory, by[12].written) == (9, 18, 9)
    assert [by[t].lag for t in (13, 14, 15)] == [6, 3, 0]
    assert tuple(flow.filled_at(states).first()) == (5, 6, 8, 8)
    assert {r.t: r.stage for r in flow.bottleneck(states).collect()}[12] == "SINK"
    assert [r.memory for r in flow.simulate(spark, 15, slow_ticks=15, credit=False).orderBy("t").collect()] == [2 * t + 1 for t in range(1, 16)]


def test_registry(spark):
    reg = registry.Registry(spark)
    assert reg.register("ClickEvent", V1) == registry.Result(True, 1, 1)
    assert reg.register("ClickEvent", V2) == registry.Result(True, 2, 2)
    refused = reg.register("ClickEvent", RENAMED)
    assert not refused.ok and len(refused.reasons) == 1
    assert reg.register("ClickEvent", V3) == registry.Result(True, 3, 3)
    assert [not reg.check("ClickEvent", REQUIRED, m) for m in ("BACKWARD", "FORWARD", "FULL")] == [False, True, False]
    with pytest.raises(KeyError):
        reg.by_id(9)
    with pytest.raises(ValueError):
        reg.check("ClickEvent", V1, "SIDEWAYS")


def test_schema_on_read(spark):
    reg = registry.Registry(spark)
    reg.register("ClickEvent", V1)
    reg.register("ClickEvent", V2)
    data = spark.createDataFrame([({"userId": "u2", "pageId": "/pricing", "ts": "2000", "campaignId": None},)], "data map<string,string>")
    new = registry.produce(data, 2)
    assert tuple(registry.consume(new, reg, reg.by_id(1)).first()) == ("u2", "/pricing", "2000")
    old = registry.produce(spark.createDataFrame([({"userId": "u1", "pageId": "/home", "ts": "1000"},)], "data map<string,string>"), 1)
    assert tuple(registry.consume(old, reg, reg.by_id(2)).first()) == ("u1", "/home", "1000", None)
    assert registry.consume(old, reg, registry.Version("x", 9, 9, V3)).first().pageUrl == ""
    with pytest.raises(Exception, match="no schema has id"):
        registry.consume(registry.produce(data, 7), reg, reg.by_id(1)).collect()


def test_two_layers_drift(spark):
    df = generators.literal(spark, USERS, "user string, t long")
    batch, speed = unified.batch_layer(df, "user"), unified.speed_layer(df, "user", "t", "seq", 2)
    assert rows(batch) == [("alice", 4), ("bob", 2)] and rows(speed) == [("alice", 3), ("bob", 2)]
    assert rows(unified.drift(batch, speed, "user")) == [("alice", 4, 3, 1), ("bob", 2, 2, 0)]


def test_generators(spark):
    views = generators.page_views(spark)
    shares = {r.country: r["count"] / 20_000 for r in views.groupBy("country").count().collect()}
    assert abs(shares["DE"] - 1 / 2) < 0.02 and abs(shares["FR"] - 1 / 3) < 0.02 and abs(shares["ES"] - 1 / 6) < 0.02
    assert views.where("ts < 0 or ts >= 7200").isEmpty()
    assert rows(generators.page_views(spark).limit(50)) == rows(generators.page_views(spark).limit(50))
