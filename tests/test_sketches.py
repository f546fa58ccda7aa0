import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import sketches
from tidemark.functions.hashing import hash32
from tidemark.sources import generators


def reference_hash(text: str, seed: int) -> int:
    h = 2166136261 ^ seed
    for c in text:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    h = (h ^ h >> 16) * 2246822507 & 0xFFFFFFFF
    h = (h ^ h >> 13) * 3266489909 & 0xFFFFFFFF
    return h ^ h >> 16


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(max_codepoint=0x7F, min_codepoint=1), max_size=12), min_size=1, max_size=20))
def test_hash32(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for seed in (0, 1, 99):
        assert [r.h for r in df.select(hash32(F.col("t"), seed).alias("h")).collect()] == [reference_hash(t, seed) for t in texts]


def test_count_min_never_counts_below_and_is_close_on_hot_items(spark):
    tags = generators.skewed_tags(spark, (("#harvest", 5_000), ("#regatta", 3_000)), 1_000, 4_000)
    grid = sketches.count_min(tags, "tag")
    exact = tags.groupBy("tag").agg(F.count("*").alias("exact"))
    both = sketches.count_min_estimate(grid, tags, "tag").join(exact, "tag")
    assert both.where("estimate < exact").isEmpty()
    hot = {r.tag: (r.estimate, r.exact) for r in both.where("exact > 100").collect()}
    assert all((e - x) / x < 0.01 for e, x in hot.values())
    assert sketches.count_min_estimate(grid, spark.createDataFrame([("#absent",)], "tag string"), "tag").first().estimate >= 0
    assert sketches.count_min_bytes(5, 2000) == 40_000


def test_count_min_merges_to_the_whole(spark):
    tags = generators.skewed_tags(spark, (("#chess", 100),), 50, 200).withColumn("part", F.length("tag") % 3)
    parts = [sketches.count_min(tags.where(f"part = {k}"), "tag", 4, 64) for k in range(3)]
    whole = sketches.count_min(tags, "tag", 4, 64)
    assert sketches.grids_equal(whole, sketches.count_min_merge(*parts)).first().equal
    assert not sketches.grids_equal(whole, parts[0]).first().equal


@pytest.mark.parametrize("n", [0, 10, 20_000])
def test_hll_is_close_and_merges(spark, n):
    users = spark.range(n).select(F.concat(F.lit("user:"), "id").alias("user"))
    whole = sketches.hll_registers(users, "user")
    if n:
        estimate = sketches.hll_estimate(whole).first().estimate
        assert abs(estimate - n) <= max(1, 0.05 * n)
        halves = [sketches.hll_registers(users.where(c), "user") for c in ("hash(user) % 2 = 0", "hash(user) % 2 <> 0")]
        assert sorted(map(tuple, sketches.hll_merge(*halves).collect())) == sorted(map(tuple, whole.collect()))
    else:
        assert whole.isEmpty()


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    members, others = generators.prefixed_ids(spark, "event", 2_000), generators.prefixed_ids(spark, "never", 10_000)
    bits = sketches.bloom_bits(members, "id", 20_000, 7)
    assert sketches.bloom_test(bits, members, "id", 20_000, 7).where("not maybe").isEmpty()
    wrong = sketches.bloom_test(bits, others, "id", 20_000, 7).where("maybe").count() / 10_000
    assert abs(wrong - sketches.bloom_false_positive_rate(2_000, 20_000, 7)) < 0.006
