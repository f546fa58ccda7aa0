"""The registered queries over the driver's tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formatting, hashing, sketches
from ..operators import changelog, eventtime, flow, joins, registry, rollup, scan, topk, unified, windows
from ..sources import generators, tables
from ..streaming import sinks, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Events with time in seconds, and the derived order of arrival, as SQL.
E = "e AS (SELECT *, floor(epoch(ts))::BIGINT AS t, (event_id + event_id * 7919 % 23) * 1000000000 + event_id % 1000000000 AS seq FROM events)"
SIX_HOURS, TEN_MINUTES, HOUR, DAY = 21_600, 600, 3_600, 86_400


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def numbers(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# Windows and event time ------------------------------------------------------------------------


@query(f"WITH {E} SELECT event_type, t // 3600 * 3600 AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL")
def w_tumbling(spark, d):
    return windows.tumbling(tables.events(spark, d), "t", HOUR, ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])


ANCHOR = 1_704_067_200  # 2024-01-01


@query(f"""WITH {E}, s AS (SELECT {ANCHOR} + k * 10800 AS window_start FROM (SELECT unnest(range(0, (SELECT (max(t) - {ANCHOR}) // 10800 + 1 FROM e))) AS k))
SELECT window_start, count(e.t) AS n FROM s LEFT JOIN e ON e.t >= window_start AND e.t < window_start + 21600 GROUP BY 1""")
def w_sliding(spark, d):
    return windows.sliding(tables.events(spark, d).where("t is not null"), "t", SIX_HOURS, 10_800, anchor=ANCHOR)


@query(f"""WITH {E}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 7200 THEN 0 ELSE 1 END AS first FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g)
SELECT user_id, min(t) AS session_start, max(t) AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def w_session(spark, d):
    return windows.sessions(tables.events(spark, d), "t", 7_200, ["user_id"])


@query(f"""WITH {E}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, event_id) <= 600 THEN 0 ELSE 1 END AS first FROM e),
s AS (SELECT *, sum(first) OVER (ORDER BY t, event_id) AS k FROM g) SELECT min(t) AS session_start, max(t) AS session_end, count(*) AS n FROM s GROUP BY k""")
def w_session_all(spark, d):
    """Sessions of all events together; Spark merges them from those of each partition."""
    return windows.sessions(tables.events(spark, d), "t", 600)


LATE = f"""{E}, m AS (SELECT *, t // {SIX_HOURS} * {SIX_HOURS} AS w, max(t) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {TEN_MINUTES} AS wm FROM e),
l AS (SELECT *, coalesce(wm >= w + {SIX_HOURS}, false) AND row_number() OVER (PARTITION BY w ORDER BY seq) > 1 AS late FROM m)"""


@query(f"""WITH {LATE} SELECT w AS window_start, w + {SIX_HOURS} AS window_end, count(*) AS n, string_agg(event_id, ',' ORDER BY seq) AS ids,
(SELECT max(t) - {TEN_MINUTES} FROM e) >= w + {SIX_HOURS} AS closed FROM l WHERE NOT late GROUP BY w""")
def w_late_drop(spark, d):
    out = eventtime.late_drop_windows(tables.events(spark, d), "t", "seq", "event_id", SIX_HOURS, TEN_MINUTES)
    return out.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(f"WITH {LATE} SELECT event_id, w AS window_start, wm AS watermark FROM l WHERE late")
def w_late_side_output(spark, d):
    return eventtime.late_events(tables.events(spark, d), "t", "seq", SIX_HOURS, TEN_MINUTES).select("event_id", "window_start", "watermark")


@query(f"WITH {E} SELECT event_id, max(t) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {TEN_MINUTES} AS watermark FROM e")
def w_watermark(spark, d):
    return eventtime.watermark(tables.events(spark, d), "t", "seq", TEN_MINUTES).select("event_id", "watermark")


@query(f"WITH {E}, m AS (SELECT *, max(t) OVER (ORDER BY seq) AS seen FROM e) SELECT user_id, count(*) AS n FROM m WHERE t >= seen - 3600 GROUP BY user_id")
def speed_layer(spark, d):
    return unified.speed_layer(tables.events(spark, d), "user_id", "t", "seq", HOUR)


@query(f"WITH {E} SELECT event_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e")
def lag_gap(spark, d):
    return windows.lag_gap(tables.events(spark, d), "t", ["user_id"], ["t", "event_id"]).select("event_id", "gap")


@query(f"WITH {E} SELECT event_id, event_type FROM e WHERE t >= {ANCHOR + DAY} AND t < {ANCHOR + 2 * DAY}")
def window_filter(spark, d):
    df = tables.events(spark, d)
    return df.where(windows.in_window(F.col("t"), ANCHOR + DAY, DAY)).select("event_id", "event_type")


@query(f"WITH {E} SELECT count(*) AS n FROM e WHERE event_type = 'click' AND t < {ANCHOR + 10 * DAY}")
def compound_filter(spark, d):
    return tables.events(spark, d).where((F.col("event_type") == "click") & (F.col("t") < ANCHOR + 10 * DAY)).agg(F.count("*").alias("n"))


# Rollups -----------------------------------------------------------------------------------------


@query(f"WITH {E} SELECT t // 60 * 60 AS minute, event_type, count(*) AS n FROM e GROUP BY ALL")
def rollup_minute(spark, d):
    return rollup.minute_counts(tables.events(spark, d), "t", ["event_type"])


def _hours(spark, d):
    return rollup.hour_counts(rollup.minute_counts(tables.events(spark, d), "t", ["event_type"]), ["event_type"])


@query(f"WITH {E} SELECT t // 3600 * 3600 AS hour, event_type, count(*) AS n FROM e GROUP BY ALL")
def rollup_hour(spark, d):
    return _hours(spark, d)


@query(f"WITH {E} SELECT count(*) AS n FROM e WHERE t // 3600 * 3600 = {ANCHOR + DAY} AND event_type = 'view'")
def rollup_lookup(spark, d):
    return rollup.lookup(_hours(spark, d), hour=ANCHOR + DAY, event_type="view")


@query(f"WITH {E} SELECT t // 3600 * 3600 AS hour, count(*) AS n FROM e GROUP BY ALL")
def rollup_slice(spark, d):
    return rollup.slice_sum(_hours(spark, d), ["hour"])


@query(f"WITH {E}, h AS (SELECT t // 86400 * 86400 AS day, event_type FROM e) SELECT day, event_type, count(*) AS n, grouping(day, event_type)::BIGINT AS grouping_id FROM h GROUP BY CUBE (day, event_type)")
def rollup_cube(spark, d):
    days = _hours(spark, d).groupBy(windows.truncate(F.col("hour"), DAY).alias("day"), "event_type").agg(F.sum("n").alias("n"))
    return rollup.grouping_cube(days, ["day", "event_type"])


@query(f"WITH {E}, h AS (SELECT t // 86400 * 86400 AS day, event_type FROM e) SELECT day, event_type, count(*) AS n, grouping(day, event_type)::BIGINT AS grouping_id FROM h GROUP BY ROLLUP (day, event_type)")
def rollup_totals(spark, d):
    days = _hours(spark, d).groupBy(windows.truncate(F.col("hour"), DAY).alias("day"), "event_type").agg(F.sum("n").alias("n"))
    return rollup.grouping_rollup(days, ["day", "event_type"])


@query(f"WITH {E} SELECT t // 3600 * 3600 AS hour, event_type, count(*) AS from_minutes, count(*) AS from_events FROM e GROUP BY ALL")
def rollup_consistency(spark, d):
    return rollup.consistency(tables.events(spark, d), "t", ["event_type"])


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(event_id) AS last_id, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def count_by_key(spark, d):
    return tables.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("event_id").alias("last_id"), F.round(F.sum("value"), 4).alias("total"))


# Sketches ----------------------------------------------------------------------------------------

# hash32 as SQL over a table i(item VARCHAR, seed BIGINT): folded, then finished.
FOLD = f"CASE WHEN item = '' THEN xor({hashing.BASIS}::HUGEINT, seed::HUGEINT) ELSE list_reduce(list_prepend(xor({hashing.BASIS}::HUGEINT, seed::HUGEINT), list_transform(string_split(item, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * {hashing.PRIME}) & {hashing.MASK}) END"


def hashed(source: str, out: str = "hashed") -> str:
    """SQL of a table like source(item, seed, ...) with h, its hash."""
    m = hashing.MASK
    return f"""{out}_0 AS (SELECT *, {FOLD} AS h0 FROM {source}),
{out}_1 AS (SELECT *, (xor(h0, h0 >> 16) * {hashing.MIX_1}) & {m}::HUGEINT AS h1 FROM {out}_0),
{out}_2 AS (SELECT *, (xor(h1, h1 >> 13) * {hashing.MIX_2}) & {m}::HUGEINT AS h2 FROM {out}_1),
{out} AS (SELECT *, xor(h2, h2 >> 16)::BIGINT AS h FROM {out}_2)"""


ITEMS = "c AS (SELECT 'u' || user_id AS item, event_type, count(*) AS n FROM events GROUP BY ALL)"


def _items(spark, d):
    return tables.table(spark, d, "events").select("event_type", "user_id", "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("item"))


@query(f"WITH i AS (SELECT DISTINCT p_name AS item, s.seed FROM part, (SELECT unnest([0, 1, 2, 99]) AS seed) s), {hashed('i')} SELECT item, seed::BIGINT AS seed, h FROM hashed")
def hash32(spark, d):
    names = tables.table(spark, d, "part").select(F.col("p_name").alias("item")).distinct()
    return names.select("item", F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("seed"), hashing.hash32(F.col("item"), s).alias("h")) for s in (0, 1, 2, 99)])).alias("x")).select("item", "x.seed", "x.h")


GRID = f"{ITEMS}, i AS (SELECT item, event_type, n, unnest(range(5)) AS seed FROM c), {hashed('i')}"


@query(f"WITH {GRID} SELECT seed::BIGINT AS row, h % 2000 AS col, sum(n)::BIGINT AS n FROM hashed GROUP BY ALL")
def cms_grid(spark, d):
    return numbers(sketches.count_min(_items(spark, d), "item"), "row")


@query(f"WITH {GRID} SELECT seed::BIGINT AS row, h % 2000 AS col, sum(n)::BIGINT AS n FROM hashed GROUP BY ALL")
def cms_merge(spark, d):
    return numbers(sketches.count_min_merge(sketches.count_min(_items(spark, d), "item", by=["event_type"])), "row")


@query(f"""WITH {GRID}, g AS (SELECT seed, h % 2000 AS col, sum(n) AS n FROM hashed GROUP BY ALL), x AS (SELECT item, sum(n)::BIGINT AS exact FROM c GROUP BY item),
q AS (SELECT h.item, min(g.n)::BIGINT AS estimate FROM (SELECT DISTINCT item, seed, h % 2000 AS col FROM hashed) h JOIN g USING (seed, col) GROUP BY h.item)
SELECT item, estimate, exact, round((estimate - exact) / exact, 9) AS error FROM q JOIN x USING (item)""")
def cms_estimate(spark, d):
    items = _items(spark, d)
    estimates = sketches.count_min_estimate(sketches.count_min(items, "item"), items, "item")
    exact = items.groupBy("item").agg(F.count("*").alias("exact"))
    return estimates.join(exact, "item").withColumn("error", F.round(sketches.relative_error(F.col("estimate"), F.col("exact")), 9))


@query(f"""WITH {GRID}, a AS (SELECT seed, h % 2000 AS col, sum(n) AS n FROM hashed GROUP BY ALL),
b AS (SELECT seed, col, sum(n) AS n FROM (SELECT seed, event_type, h % 2000 AS col, sum(n) AS n FROM hashed GROUP BY ALL) GROUP BY ALL)
SELECT NOT EXISTS (SELECT 1 FROM a FULL JOIN b USING (seed, col) WHERE a.n IS DISTINCT FROM b.n) AS equal""")
def cms_equal(spark, d):
    items = _items(spark, d)
    return sketches.grids_equal(sketches.count_min(items, "item"), sketches.count_min_merge(sketches.count_min(items, "item", by=["event_type"])))


REGISTERS = f"""i AS (SELECT DISTINCT 'e' || event_id AS item, event_type, 0 AS seed FROM events), {hashed('i')},
r AS (SELECT event_type, h >> 20 AS register, max(33 - length(bin(((h << 12) | 2048) & {hashing.MASK})))::INTEGER AS rank FROM hashed GROUP BY ALL)"""


def _ids(spark, d):
    return tables.table(spark, d, "events").select("event_type", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("item"))


@query(f"WITH {REGISTERS} SELECT register, max(rank) AS rank FROM r GROUP BY register")
def hll_registers(spark, d):
    return sketches.hll_registers(_ids(spark, d), "item")


@query(f"WITH {REGISTERS} SELECT register, max(rank) AS rank FROM r GROUP BY register")
def hll_merge(spark, d):
    return sketches.hll_merge(sketches.hll_registers(_ids(spark, d), "item", by=["event_type"]))


@query(f"""WITH {REGISTERS}, z AS (SELECT sum(pow(2.0, -rank)) AS s, 4096 - count(*) AS empty FROM (SELECT register, max(rank) AS rank FROM r GROUP BY register)),
w AS (SELECT (0.7213 / (1 + 1.079 / 4096)) * 4096 * 4096 / (s + empty) AS raw, empty FROM z)
SELECT floor(CASE WHEN raw <= 2.5 * 4096 AND empty > 0 THEN 4096.0::DOUBLE * ln(4096.0::DOUBLE / empty) ELSE raw END + 0.5)::BIGINT AS estimate, (SELECT count(DISTINCT event_id) FROM events) AS exact FROM w""")
def hll_estimate(spark, d):
    exact = tables.table(spark, d, "events").agg(F.count_distinct("event_id")).scalar()
    return sketches.hll_estimate(sketches.hll_registers(_ids(spark, d), "item")).withColumn("exact", exact)


M, K = 20_000, 7


def _position(h1: str, h2: str) -> str:
    return f"unnest(list_transform(range({K}), lambda i: ({h1} + i * {h2}) % {M}))"


BLOOM = f"""n AS (SELECT DISTINCT p_name AS item FROM part WHERE p_partkey % 2 = 0), u AS (SELECT DISTINCT p_name AS item FROM part),
i AS (SELECT item, unnest([1, 2]) AS seed FROM u), {hashed('i')},
p AS (SELECT item, max(h) FILTER (seed = 1) AS h1, max(h) FILTER (seed = 2) AS h2 FROM hashed GROUP BY item),
x AS (SELECT item, {_position('h1', 'h2')} AS position FROM p), bits AS (SELECT DISTINCT position FROM x WHERE item IN (SELECT item FROM n)),
tested AS (SELECT x.item, bool_and(bits.position IS NOT NULL) AS maybe FROM (SELECT DISTINCT * FROM x) x LEFT JOIN bits USING (position) GROUP BY x.item)"""


def _bloom(spark, d):
    part = tables.table(spark, d, "part")
    members = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("item")).distinct()
    return members, part.select(F.col("p_name").alias("item")).distinct(), sketches.bloom_bits(members, "item", M, K)


@query(f"WITH {BLOOM} SELECT position FROM bits")
def bloom_bits(spark, d):
    return _bloom(spark, d)[2]


@query(f"WITH {BLOOM} SELECT item, maybe FROM tested")
def bloom_test(spark, d):
    _, every, bits = _bloom(spark, d)
    return sketches.bloom_test(bits, every, "item", M, K)


@query(f"""WITH {BLOOM} SELECT count(*) FILTER (item IN (SELECT item FROM n) AND NOT maybe) AS false_negatives, count(*) FILTER (item NOT IN (SELECT item FROM n) AND maybe) AS false_positives,
round(pow(1 - exp(-{K}.0 * (SELECT count(*) FROM n) / {M}), {K}), 9) AS theory FROM tested""")
def bloom_errors(spark, d):
    members, every, bits = _bloom(spark, d)
    tested = joins.member_flag(sketches.bloom_test(bits, every, "item", M, K), members, "item")
    n = members.agg(F.count("*")).scalar()
    counted = tested.agg(F.count_if(F.col("member") & ~F.col("maybe")).alias("false_negatives"), F.count_if(~F.col("member") & F.col("maybe")).alias("false_positives"))
    theory = F.round(F.pow(1 - F.exp(F.lit(-float(K)) * n / M), F.lit(float(K))), 9)
    return counted.withColumn("theory", theory)


@query("SELECT true AS ids_close, true AS users_close, true AS top_exact")
def builtin_sketches(spark, d):
    """Spark's own sketches for the same questions: how close they are, as their values are Spark's."""
    df = tables.table(spark, d, "events")
    top = df.groupBy("event_type").agg(F.count("*").alias("n")).agg(F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, 3)).scalar()  # one number a type
    ids, users = df.agg(F.count_distinct("event_id")).scalar(), df.agg(F.count_distinct("user_id")).scalar()
    found = df.agg(F.hll_sketch_estimate(F.hll_sketch_agg("event_id", F.lit(12))).alias("ids"), F.approx_count_distinct("user_id", 0.02).alias("users"), F.expr("approx_top_k(event_type, 3)").alias("top"))
    close = lambda name, exact: F.abs(sketches.relative_error(F.col(name), exact)) <= 0.06
    return found.select(close("ids", ids).alias("ids_close"), close("users", users).alias("users_close"), (F.col("top.count") == top).alias("top_exact"))


@query("SELECT true AS never_below, true AS hot_within_1_percent, true AS all_hot_within_2_percent, 40000::BIGINT AS bytes")
def accuracy_count_min(spark, d):
    """On 300,000 generated tags; hot: in over 10,000 rows, all hot: in over 5,000, where the mean excess of a cell (150) tells more."""
    tags = generators.skewed_tags(spark)
    exact = tags.groupBy("tag").agg(F.count("*").alias("exact"))
    both = sketches.count_min_estimate(sketches.count_min(tags, "tag"), exact, "tag").join(exact, "tag")
    worst = lambda rows: F.max(F.when(F.col("exact") >= rows, sketches.relative_error(F.col("estimate"), F.col("exact"))))
    return both.agg((F.min(F.col("estimate") - F.col("exact")) >= 0).alias("never_below"), (worst(10_000) < 0.01).alias("hot_within_1_percent"), (worst(5_000) < 0.02).alias("all_hot_within_2_percent")).withColumn("bytes", F.lit(sketches.count_min_bytes(5, 2000)).cast("long"))


@query("SELECT true AS within_3_percent, 200000::BIGINT AS exact")
def accuracy_hll(spark, d):
    """On 1,000,000 events of 200,000 generated users."""
    users = generators.repeated_users(spark)
    found = sketches.hll_estimate(sketches.hll_registers(users, "user")).withColumn("exact", users.agg(F.count_distinct("user")).scalar())
    return found.select((F.abs(sketches.relative_error(F.col("estimate"), F.col("exact"))) <= 0.03).alias("within_3_percent"), "exact")


@query("SELECT 0::BIGINT AS false_negatives, true AS within_1_percent, round(pow(1 - exp(-7.0 * 10000 / 100000), 7), 9) AS theory")
def accuracy_bloom(spark, d):
    """10,000 members in 100,000 bits by 7 hashes, probed with 100,000 others."""
    members, others = generators.prefixed_ids(spark, "event", 10_000), generators.prefixed_ids(spark, "never", 100_000)
    bits = sketches.bloom_bits(members, "id")
    tested = sketches.bloom_test(bits, members.unionByName(others), "id").withColumn("member", F.col("id").startswith("event:"))
    wrong = F.count_if(~F.col("member") & F.col("maybe")) / F.count_if(~F.col("member"))
    out = tested.agg(F.count_if(F.col("member") & ~F.col("maybe")).alias("false_negatives"), (wrong < 0.01).alias("within_1_percent"))
    return out.withColumn("theory", F.round(F.lit(sketches.bloom_false_positive_rate(10_000, 100_000, 7)), 9))


@query("SELECT event_type, printf('%.2f', round(sum(value), 2)) AS total, format('{:,}', sum(event_id)::BIGINT) AS ids, '{\"type\":\"' || event_type || '\",\"n\":' || count(*) || '}' AS row FROM events GROUP BY event_type")
def format_rows(spark, d):
    counts = tables.table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("v"), F.sum("event_id").alias("i"), F.count("*").alias("n"))
    return counts.select("event_type", formatting.fixed(F.col("v"), 2).alias("total"), formatting.grouped(F.col("i")).alias("ids"), formatting.json(type=F.col("event_type"), n=F.col("n")).alias("row"))


# Top-K -------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def topk_exact(spark, d):
    return topk.exact(tables.table(spark, d, "events"), "user_id", 10)


@query(f"""WITH {E}, c AS (SELECT t // {DAY} * {DAY} AS day, user_id, count(*) AS n FROM e GROUP BY ALL)
SELECT day, user_id, n, row_number() OVER (PARTITION BY day ORDER BY n DESC, user_id) AS rank FROM c QUALIFY rank <= 3""")
def topk_per_window(spark, d):
    counts = tables.events(spark, d).groupBy(windows.truncate(F.col("t"), DAY).alias("day"), "user_id").agg(F.count("*").alias("n"))
    return numbers(topk.per_group(counts, ["day"], "user_id", "n", 3), "rank")


def _plays(spark, d):
    df = tables.events(spark, d)
    return df.select(windows.truncate(F.col("t"), DAY).alias("win"), topk.shard_of("event_id", 2).alias("shard"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("item"), "event_id")


# Every user is a candidate, as in the fast path without a pool, so the best estimates of all are the fast path's.
SHARDS = f"""{E}, p AS (SELECT t // {DAY} * {DAY} AS win, 'u' || user_id AS name, count(*) AS n FROM e GROUP BY ALL),
i AS (SELECT DISTINCT name AS item, s.seed FROM p, (SELECT unnest(range(4)) AS seed) s), {hashed('i', 'i_hashed')},
cells AS (SELECT item AS name, seed AS r, h % 1024 AS c FROM i_hashed),
grid AS (SELECT win, r, c, sum(n) AS n FROM p JOIN cells USING (name) GROUP BY ALL)"""


@query(f"""WITH {SHARDS}
SELECT win, item, estimate, row_number() OVER (PARTITION BY win ORDER BY estimate DESC, item) AS rank FROM (
SELECT win, name AS item, min(grid.n)::BIGINT AS estimate FROM p JOIN cells USING (name) JOIN grid USING (win, r, c) GROUP BY ALL) QUALIFY rank <= 3""")
def topk_fast_windows(spark, d):
    return numbers(topk.fast_path(_plays(spark, d), "win", "shard", "item", 3)[0], "rank")


DAILY = """daily AS (SELECT name AS item, min(m.n)::BIGINT AS estimate FROM (SELECT DISTINCT name FROM p) JOIN cells USING (name) JOIN (SELECT r, c, sum(n) AS n FROM grid GROUP BY ALL) m USING (r, c) GROUP BY ALL),
fast AS (SELECT item, estimate, row_number() OVER (ORDER BY estimate DESC, item) AS rank FROM daily QUALIFY rank <= 10)"""


@query(f"WITH {SHARDS}, {DAILY} SELECT * FROM fast")
def topk_fast_total(spark, d):
    return numbers(topk.fast_path(_plays(spark, d), "win", "shard", "item", 10)[1], "rank")


def _ranked_exact(spark, d):
    return topk.per_group(_items(spark, d).groupBy("item").agg(F.count("*").alias("n")).withColumn("g", F.lit(0)), ["g"], "item", "n", 10).drop("g")


@query(f"""WITH {SHARDS}, {DAILY}, x AS (SELECT 'u' || user_id AS item, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, 'u' || user_id) AS rank FROM events GROUP BY user_id QUALIFY rank <= 10)
SELECT rank, fast.item AS fast_item, x.item AS exact_item, fast.item IS NOT DISTINCT FROM x.item AS same, fast.item IN (SELECT item FROM x) AS in_exact FROM fast FULL JOIN x USING (rank)""")
def topk_compare(spark, d):
    fast = topk.fast_path(_plays(spark, d), "win", "shard", "item", 10)[1]
    return numbers(topk.compare(fast, _ranked_exact(spark, d), "item"), "rank")


@query(f"""WITH {SHARDS}, {DAILY}, x AS (SELECT 'u' || user_id AS item FROM events GROUP BY user_id ORDER BY count(*) DESC, 'u' || user_id LIMIT 10)
SELECT count(*) AS hits, count(*) / 10.0::DOUBLE AS precision FROM fast WHERE item IN (SELECT item FROM x)""")
def topk_precision(spark, d):
    return topk.precision(topk.fast_path(_plays(spark, d), "win", "shard", "item", 10)[1], _ranked_exact(spark, d), "item", 10)


@query()
def topk_heap(spark, d):
    """Held by a bounded heap in order of arrival: what it holds depends on that order, tests replay it."""
    return topk.heap_in_order(_plays(spark, d), ["win", "shard"], "item", "event_id", 10)


@query("SELECT (2 * 30 * 4 * 1024 * 4)::BIGINT AS sketch_bytes, (2 * 30 * 32 * 10)::BIGINT AS heap_bytes, (SELECT sum(2 * length(user_id::VARCHAR) + 48)::BIGINT FROM (SELECT DISTINCT user_id FROM events)) AS exact_bytes")
def topk_memory(spark, d):
    return topk.memory(tables.table(spark, d, "events"), "user_id", 2, 30, 10)


# Changelogs --------------------------------------------------------------------------------------

LOG = "log AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS value, event_id AS seq FROM events)"


def _log(spark, d):
    return tables.table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.col("event_id").alias("seq"))


@query(f"WITH {LOG} SELECT user_id, value FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1 AND value IS NOT NULL")
def changelog_fold(spark, d):
    return changelog.fold(_log(spark, d), ["user_id"], "value", "seq")


@query(f"WITH {LOG} SELECT user_id, value, seq FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1")
def changelog_compact(spark, d):
    return changelog.compact(_log(spark, d), ["user_id"], "seq")


@query("SELECT true AS equal")
def changelog_equivalence(spark, d):
    log = _log(spark, d)
    return changelog.tables_equal(changelog.fold(log, ["user_id"], "value", "seq"), changelog.fold(changelog.compact(log, ["user_id"], "seq"), ["user_id"], "value", "seq"))


WRITES = """w AS (SELECT event_id AS seq, user_id, CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op, value FROM events),
a AS (SELECT *, CASE WHEN op <> 'd' THEN value END AS after FROM w)"""


def _writes(spark, d):
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    return tables.table(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", op.alias("op"), "value")


@query(f"WITH {WRITES} SELECT seq, user_id, op, lag(after) OVER (PARTITION BY user_id ORDER BY seq) AS before, after FROM a")
def cdc_capture(spark, d):
    return changelog.capture(_writes(spark, d), ["user_id"], "op", "value", "seq").select("seq", "user_id", "op", "before", "after")


@query(f"WITH {WRITES} SELECT user_id, after AS value FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1 AND op <> 'd'")
def cdc_replica(spark, d):
    return changelog.replicate(changelog.capture(_writes(spark, d), ["user_id"], "op", "value", "seq"), ["user_id"], "op", "seq")


SNAPSHOTS = f"""{LOG}, o AS (SELECT user_id, arg_max_null(value, seq) AS value FROM log WHERE seq < (SELECT count(*) FROM log) // 2 GROUP BY 1), n AS (SELECT user_id, arg_max_null(value, seq) AS value FROM log GROUP BY 1)"""


@query(f"""WITH {SNAPSHOTS}, a AS (SELECT * FROM o WHERE value IS NOT NULL), b AS (SELECT * FROM n WHERE value IS NOT NULL)
SELECT user_id, CASE WHEN a.value IS NULL THEN 'c' WHEN b.value IS NULL THEN 'd' ELSE 'u' END AS op, a.value AS before, b.value AS after FROM a FULL JOIN b USING (user_id) WHERE a.value IS DISTINCT FROM b.value""")
def cdc_snapshots(spark, d):
    log = _log(spark, d)
    half = log.agg(F.floor(F.count("*") / 2)).scalar()
    old = log.where(F.col("seq") < half)
    return changelog.snapshot_changes(changelog.fold(old, ["user_id"], "value", "seq"), changelog.fold(log, ["user_id"], "value", "seq"), ["user_id"], "value")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def latest_per_key(spark, d):
    return changelog.latest(tables.table(spark, d, "events").select("user_id", "event_type", "event_id", "value").withColumn("o", F.col("event_id")), ["user_id", "event_type"], "o").drop("o")


# Joins -------------------------------------------------------------------------------------------


def _clicks(spark, d):
    df = tables.events(spark, d).select(F.col("user_id").alias("key"), F.col("t").alias("ts"), F.col("event_id").alias("id"), "event_type")
    return df.where("event_type = 'click'").drop("event_type"), df.where("event_type = 'view'").drop("event_type")


@query(f"""WITH {E}, c AS (SELECT user_id AS key, t AS ts, event_id AS id FROM e WHERE event_type = 'click'),
i AS (SELECT user_id AS key, t AS its, event_id AS iid FROM e WHERE event_type = 'view'),
j AS (SELECT c.*, i.its, i.iid, row_number() OVER (PARTITION BY c.id ORDER BY i.its DESC, i.iid DESC) AS rn FROM c LEFT JOIN i ON i.key = c.key AND i.its <= c.ts AND c.ts - i.its <= 43200)
SELECT key, ts, id, its AS impression_ts, iid AS impression_id, ts - its AS gap FROM j WHERE rn = 1""")
def join_attribution(spark, d):
    clicks, views = _clicks(spark, d)
    return joins.attribute(clicks, views, "key", "ts", "id", 43_200)


def _versions(spark, d):
    return tables.events(spark, d).where("event_type = 'purchase'").select(F.col("t").alias("valid_from"), F.col("value").alias("price"), "event_id")


VERSIONS = f"{E}, v AS (SELECT t AS valid_from, value AS price FROM e WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY t ORDER BY event_id DESC) = 1)"
FACTS = "f AS (SELECT event_id, t FROM e WHERE event_type = 'signup')"


def _prices(spark, d):
    v = _versions(spark, d)
    return changelog.latest(v, ["valid_from"], "event_id").select("valid_from", "price")


@query(f"WITH {VERSIONS}, {FACTS} SELECT event_id, t, coalesce(v.price, (SELECT arg_min(price, valid_from) FROM v)) AS price FROM f ASOF LEFT JOIN v ON f.t >= v.valid_from")
def join_as_of(spark, d):
    facts = tables.events(spark, d).where("event_type = 'signup'").select("event_id", "t")
    return joins.as_of(facts, _prices(spark, d), "t", "valid_from", "price")


@query(f"""WITH {E}, v AS (SELECT user_id, t AS valid_from, value AS price FROM e WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY event_id DESC) = 1),
f AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'signup') SELECT event_id, f.user_id, t, v.price FROM f ASOF LEFT JOIN v ON f.user_id = v.user_id AND f.t >= v.valid_from""")
def join_as_of_keyed(spark, d):
    df = tables.events(spark, d)
    v = df.where("event_type = 'purchase'").select("user_id", F.col("t").alias("valid_from"), F.col("value").alias("price"), "event_id")
    v = changelog.latest(v, ["user_id", "valid_from"], "event_id").select("user_id", "valid_from", "price")
    return joins.as_of(df.where("event_type = 'signup'").select("event_id", "user_id", "t"), v, "t", "valid_from", "price", ["user_id"], first_before=False)


@query(f"WITH {VERSIONS}, {FACTS} SELECT event_id, t, (SELECT arg_max(price, valid_from) FROM v) AS price FROM f")
def join_current(spark, d):
    facts = tables.events(spark, d).where("event_type = 'signup'").select("event_id", "t")
    return joins.current(facts, _prices(spark, d), "valid_from", "price")


@query(f"""WITH {LOG}, p AS (SELECT user_id, arg_max_null(value, seq) AS value FROM log GROUP BY 1), q AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, value, n FROM p JOIN q USING (user_id) WHERE value IS NOT NULL""")
def join_tables(spark, d):
    counts = tables.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return joins.table_join(changelog.fold(_log(spark, d), ["user_id"], "value", "seq"), counts, ["user_id"])


@query("""WITH a AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS rank FROM events GROUP BY 1 QUALIFY rank <= 5),
b AS (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rank FROM orders GROUP BY 1 QUALIFY rank <= 5)
SELECT rank, a.user_id AS l_user_id, a.n AS l_n, b.o_custkey AS r_o_custkey, b.n AS r_n FROM a FULL JOIN b USING (rank)""")
def join_ranks(spark, d):
    a = tables.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    b = tables.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return numbers(joins.side_by_side(a, b, [F.desc("n"), F.asc("user_id")], [F.desc("n"), F.asc("o_custkey")], 5), "rank")


@query("SELECT o_orderkey, o_custkey, o_custkey IN (SELECT user_id FROM events) AS member FROM orders")
def join_member_flag(spark, d):
    users = tables.table(spark, d, "events").select(F.col("user_id").alias("o_custkey"))
    return joins.member_flag(tables.table(spark, d, "orders").select("o_orderkey", "o_custkey"), users, "o_custkey")


# Sets --------------------------------------------------------------------------------------------


def _sets(spark, d):
    df = tables.table(spark, d, "events")
    return df.where("event_type = 'click'").select("user_id"), df.where("event_type = 'purchase'").select("user_id")


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY 1")
def set_union_all(spark, d):
    a, b = _sets(spark, d)
    return a.unionByName(b).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_union(spark, d):
    a, b = _sets(spark, d)
    return a.union(b).distinct()


@query("SELECT count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')")
def set_intersection_size(spark, d):
    a, b = _sets(spark, d)
    return a.intersect(b).agg(F.count("*").alias("n"))


@query("SELECT NOT EXISTS (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'purchase') AND NOT EXISTS (SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'click') AS equal")
def set_equal(spark, d):
    return changelog.tables_equal(*_sets(spark, d))


# Recovery and the two designs --------------------------------------------------------------------


@query("SELECT count(*) AS counter, count(DISTINCT event_id) AS upsert FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 5 = 0)")
def replay_totals(spark, d):
    """What a counter and an upsert by id make of a log of which a fifth is sent again."""
    ids = tables.table(spark, d, "events").select("event_id")
    return ids.union(ids.where("event_id % 5 = 0")).agg(F.count("*").alias("counter"), F.count_distinct("event_id").alias("upsert"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def unified_counts(spark, d):
    return unified.count_step(tables.table(spark, d, "events"), "user_id")


@query(f"""WITH {E}, b AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), m AS (SELECT *, max(t) OVER (ORDER BY seq) AS seen FROM e), s AS (SELECT user_id, count(*) AS n FROM m WHERE t >= seen - 3600 GROUP BY 1)
SELECT user_id, coalesce(b.n, 0) AS batch_n, coalesce(s.n, 0) AS speed_n, coalesce(b.n, 0) - coalesce(s.n, 0) AS drift FROM b FULL JOIN s USING (user_id)""")
def lambda_drift(spark, d):
    df = tables.events(spark, d)
    return unified.drift(unified.batch_layer(df, "user_id"), unified.speed_layer(df, "user_id", "t", "seq", HOUR), "user_id")


@query("SELECT true AS equal")
def replay_determinism(spark, d):
    df = tables.events(spark, d)
    once = unified.speed_layer(df, "user_id", "t", "seq", HOUR)
    again = unified.speed_layer(df.repartition(7), "user_id", "t", "seq", HOUR)
    return changelog.tables_equal(once, again)


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS running FROM events")
def running_count(spark, d):
    return scan.running_count(tables.table(spark, d, "events").select("event_id", "user_id"), "event_id", "running", ["user_id"])


@query("SELECT 'impression' AS kind, event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type = 'view' UNION ALL SELECT 'click', event_id, user_id, floor(epoch(ts))::BIGINT FROM events WHERE event_type = 'click' ORDER BY t, event_id")
def merged_streams(spark, d):
    """Two streams as one, in order of event time."""
    df = tables.events(spark, d)
    views, clicks = (df.where(F.col("event_type") == e).select(F.lit(kind).alias("kind"), "event_id", "user_id", "t") for e, kind in (("view", "impression"), ("click", "click")))
    return views.unionByName(clicks).orderBy("t", "event_id")


# Streams -----------------------------------------------------------------------------------------


def _stream(spark, d):
    """events as a stream with t and seq."""
    schema = tables.table(spark, d, "events").schema
    return tables.with_times(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


def _files(spark, df: DataFrame, part, parts: int) -> str:
    """A folder with a file for each part, written one after another: a stream of so many batches."""
    folder = streams.scratch_folder(spark)
    for k in range(parts):
        df.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _batches(spark, d, parts: int = 4) -> DataFrame:
    """events in order of arrival, in so many batches."""
    df = tables.events(spark, d).select("event_id", "user_id", "t", "seq")
    most = df.agg(F.max("seq")).first()[0] or 0
    return streams.replayable(spark, _files(spark, df, F.floor(F.col("seq") * float(parts) / (most + 1)), parts), df.schema.simpleString()[7:-1].replace(":", " "))


def _finished(spark, df: DataFrame, mode: str) -> DataFrame:
    """What a stream has emitted when its sources are at their end."""
    folder = streams.scratch_folder(spark)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/out")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_counts(spark, d):
    return _finished(spark, unified.count_step(_stream(spark, d), "user_id"), "complete")


@query(f"""WITH {E}, w AS (SELECT event_type, t // 3600 * 3600 AS window_start, count(*) AS n FROM e GROUP BY ALL)
SELECT * FROM w WHERE window_start + 3600 <= (SELECT max(t) - {TEN_MINUTES} FROM e)""")
def stream_windows(spark, d):
    """Closed windows only, as append mode has it; in one batch no event is late."""
    return _finished(spark, streams.windowed_counts(_stream(spark, d), "t", HOUR, TEN_MINUTES, ["event_type"]), "append")


@query(f"""WITH {E}, m AS (SELECT *, t // {DAY} * {DAY} AS w, max(t) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {TEN_MINUTES} AS wm FROM e),
l AS (SELECT *, coalesce(wm >= w + {DAY}, false) AND row_number() OVER (PARTITION BY user_id, w ORDER BY seq) > 1 AS late FROM m),
x AS (SELECT user_id, max(t) - {TEN_MINUTES} AS final FROM e GROUP BY user_id)
SELECT l.user_id::VARCHAR AS key, w AS window_start, count(*) AS n FROM l JOIN x USING (user_id) WHERE NOT late GROUP BY l.user_id, w, final HAVING w + {DAY} <= final""")
def stream_late_drop(spark, d):
    """The lateness rule event by event, per user, with state, over four batches."""
    return _finished(spark, streams.exact_late_drop(_batches(spark, d), "t", "seq", DAY, TEN_MINUTES, "user_id"), "append")


@query(f"""WITH {LATE} SELECT 'all' AS key, w AS window_start, count(*) AS n FROM l WHERE NOT late GROUP BY w HAVING (SELECT max(t) - {TEN_MINUTES} FROM e) >= w + {SIX_HOURS}""")
def stream_late_drop_all(spark, d):
    """The rule over all events, which is one order and so one task a batch."""
    return _finished(spark, streams.exact_late_drop(_batches(spark, d).withColumn("key", F.lit("all")), "t", "seq", SIX_HOURS, TEN_MINUTES, "key"), "append")


@query("""SELECT count(*) + count(*) FILTER (event_id % 4 = 2) AS counter, count(DISTINCT event_id) AS upsert, count(*) AS transactional, 1 AS crashes FROM events""")
def stream_sinks(spark, d):
    """Three sinks after a crash behind the third of four batches: what is sent again counts again in the first only."""
    folder = streams.scratch_folder(spark)
    log = _files(spark, tables.table(spark, d, "events").select("event_id"), F.col("event_id") % 4, 4)
    made = (sinks.CounterSink(f"{folder}/counter", sinks.CrashOnce(2)), sinks.UpsertSink(f"{folder}/upsert", "event_id", sinks.CrashOnce(2)), sinks.TransactionalSink(f"{folder}/whole", sinks.CrashOnce(2)))
    crashes = [streams.run_with_restarts(lambda: streams.replayable(spark, log, "event_id long"), f"{folder}/check-{k}", sink) for k, sink in enumerate(made)]
    totals = [sink.total(spark) for sink in made]
    return spark.createDataFrame([(*totals, max(crashes))], "counter long, upsert long, transactional long, crashes int")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_recovered(spark, d):
    """Counts whose state is taken up from the checkpoint after a crash in the third of four batches."""
    folder = streams.scratch_folder(spark)
    log = _files(spark, tables.table(spark, d, "events").select("event_id", "user_id"), F.col("event_id") % 4, 4)
    sink = sinks.UpsertSink(f"{folder}/counts", "user_id", sinks.CrashOnce(2))
    streams.run_with_restarts(lambda: unified.count_step(streams.replayable(spark, log, "event_id long, user_id long"), "user_id"), f"{folder}/check", sink, mode="update")
    return sink.read(spark).select("user_id", "n")


@query(f"""WITH {E}, c AS (SELECT * FROM e WHERE event_type = 'click'), i AS (SELECT * FROM e WHERE event_type = 'view')
SELECT c.event_id AS click_id, i.event_id AS impression_id FROM c LEFT JOIN i ON i.user_id = c.user_id AND i.t <= c.t AND c.t - i.t <= 43200
QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY i.t DESC, i.event_id DESC) = 1""")
def stream_last_touch(spark, d):
    """Two streams of four batches by time; two events far ahead let the last clicks out."""
    sides = []
    for kind in ("click", "view"):
        df = tables.events(spark, d).where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), "t", F.col("event_id").alias("id"))
        ahead = spark.createDataFrame([(-1, ANCHOR + 10_000 * DAY, -1), (-1, ANCHOR + 20_000 * DAY, -2)], "key long, t long, id long")
        part = F.greatest(F.lit(0), F.floor((F.col("t") - ANCHOR) / (8 * DAY)))
        log = _files(spark, df.unionByName(ahead), F.when(F.col("id") < 0, 3 - F.col("id")).otherwise(F.least(part, F.lit(3))), 6)
        sides.append(streams.replayable(spark, log, "key long, t long, id long"))
    return _finished(spark, streams.last_touch(*sides, "key", "t", 43_200, 23 * HOUR), "append").where("click_id >= 0")


# Flow control ------------------------------------------------------------------------------------

FLOW = """WITH RECURSIVE s AS (
SELECT 0::BIGINT AS t, 0::BIGINT AS produced, 0::BIGINT AS consumed, 0::BIGINT AS map, 0::BIGINT AS win, 0::BIGINT AS sink, 0::BIGINT AS written, false AS throttled
UNION ALL SELECT t + 1, produced + 3, consumed + take, map - m2w + take, win - w2s + m2w, sink - drain + w2s, written + drain, take < least(6, avail) FROM (
  SELECT *, least(6, avail, 6 - (map - m2w)) AS take FROM (
    SELECT *, least(6, map, 6 - (win - w2s)) AS m2w, produced + 3 - consumed AS avail FROM (
      SELECT *, least(6, win, 6 - (sink - drain)) AS w2s FROM (SELECT *, least(sink, CASE WHEN t + 1 <= 12 THEN 1 ELSE 6 END) AS drain FROM s WHERE t < 19)))))"""


@query(FLOW + " SELECT t, produced, consumed, map, win, sink, written, throttled, produced - consumed AS lag, map + win + sink AS memory FROM s WHERE t > 0")
def flow_credit(spark, d):
    return flow.simulate(spark, 19)


@query("""WITH RECURSIVE s AS (SELECT 0::BIGINT AS t, 0::BIGINT AS sink UNION ALL SELECT t + 1, sink - least(sink, 1) + 3 FROM s WHERE t < 15)
SELECT t, sink AS memory FROM s WHERE t > 0""")
def flow_naive(spark, d):
    return flow.simulate(spark, 15, slow_ticks=15, credit=False).select("t", "memory")


@query(FLOW + " SELECT t, CASE WHEN sink >= 6 THEN 'SINK' WHEN win >= 6 THEN 'WINDOW' WHEN map >= 6 THEN 'MAP' END AS stage FROM s WHERE t > 0")
def flow_bottleneck(spark, d):
    return flow.bottleneck(flow.simulate(spark, 19))


@query(FLOW + " SELECT min(t) FILTER (sink >= 6) AS sink_full, min(t) FILTER (win >= 6) AS window_full, min(t) FILTER (map >= 6) AS map_full, min(t) FILTER (throttled) AS throttled_at FROM s")
def flow_filled(spark, d):
    return flow.filled_at(flow.simulate(spark, 19))


# Schema registry ---------------------------------------------------------------------------------

V1 = (registry.Field("userId", "string"), registry.Field("pageId", "string"), registry.Field("ts", "number"))
V2 = (*V1, registry.Field("campaignId", "string", True, True, None))
RENAMED = (V1[0], registry.Field("pageUrl", "string"), V1[2], V2[3])
V3 = (*V2, registry.Field("pageUrl", "string", True, True, ""))
REQUIRED = (*V3, registry.Field("sessionId", "string"))


def _values(fields: tuple) -> str:
    return "(VALUES " + ", ".join(f"('{f.name}', '{f.type}', {str(f.has_default).lower()})" for f in fields) + ") v(name, type, has_default)"


def _cases() -> str:
    cases = {"add_optional": (V1, V2), "rename": (V2, RENAMED), "add_default": (V2, V3), "add_required": (V3, REQUIRED)}
    o = " UNION ALL ".join(f"SELECT '{c}' AS change, * FROM {_values(a)}" for c, (a, _) in cases.items())
    n = " UNION ALL ".join(f"SELECT '{c}' AS change, * FROM {_values(b)}" for c, (_, b) in cases.items())
    return f"o AS ({o}), n AS ({n})"


@query(f"""WITH {_cases()}, j AS (SELECT change, name, o.type AS ot, o.has_default AS od, n.type AS nt, n.has_default AS nd FROM o FULL JOIN n USING (change, name))
SELECT change, name, 'BACKWARD' AS direction, 'added without default' AS problem FROM j WHERE ot IS NULL AND NOT nd
UNION ALL SELECT change, name, unnest(['BACKWARD', 'FORWARD']), 'type changed' FROM j WHERE ot <> nt
UNION ALL SELECT change, name, 'FORWARD', 'removed without default' FROM j WHERE nt IS NULL AND NOT od""")
def schema_problems(spark, d):
    cases = {"add_optional": (V1, V2), "rename": (V2, RENAMED), "add_default": (V2, V3), "add_required": (V3, REQUIRED)}
    side = lambda k: spark.createDataFrame([(c, f.name, f.type, f.has_default) for c, pair in cases.items() for f in pair[k]], "change string, name string, type string, has_default boolean")
    return registry.problems(side(0), side(1), ["change"])


def _registry(spark):
    reg = registry.Registry(spark)
    results = [("v1", "BACKWARD", reg.register("ClickEvent", V1)), ("v2", "BACKWARD", reg.register("ClickEvent", V2)), ("rename", "BACKWARD", reg.register("ClickEvent", RENAMED)), ("v3", "BACKWARD", reg.register("ClickEvent", V3))]
    for mode in registry.MODES:
        reasons = reg.check("ClickEvent", REQUIRED, mode)
        results.append(("add_required", mode, registry.Result(not reasons, reasons=reasons)))
    return reg, results


@query("""SELECT * FROM (VALUES ('v1', 'BACKWARD', true, 1::BIGINT, 0::BIGINT), ('v2', 'BACKWARD', true, 2, 0), ('rename', 'BACKWARD', false, NULL, 1), ('v3', 'BACKWARD', true, 3, 0),
('add_required', 'BACKWARD', false, NULL, 1), ('add_required', 'FORWARD', true, NULL, 0), ('add_required', 'FULL', false, NULL, 1)) v(change, mode, ok, id, reasons)""")
def schema_register(spark, d):
    rows = [(c, m, r.ok, r.id, len(r.reasons)) for c, m, r in _registry(spark)[1]]
    return spark.createDataFrame(rows, "change string, mode string, ok boolean, id long, reasons long")


@query("""SELECT event_id, user_id::VARCHAR AS "userId", event_type AS "pageId", event_id::VARCHAR AS ts, CASE WHEN event_id % 4 = 2 THEN 'c' || user_id END AS "campaignId", '' AS "pageUrl" FROM events""")
def schema_consume(spark, d):
    """Two versions read by a third: a field neither has takes its default, a null that is there stays."""
    reg, _ = _registry(spark)
    df = tables.table(spark, d, "events")
    base = [F.lit("userId"), F.col("user_id").cast("string"), F.lit("pageId"), F.col("event_type"), F.lit("ts"), F.col("event_id").cast("string")]
    old = registry.produce(df.where("event_id % 2 = 1").select("event_id", F.create_map(*base).alias("data")), 1)
    campaign = F.when(F.col("event_id") % 4 == 2, F.concat(F.lit("c"), F.col("user_id").cast("string")))
    new = registry.produce(df.where("event_id % 2 = 0").select("event_id", F.create_map(*base, F.lit("campaignId"), campaign).alias("data")), 2)
    return registry.consume(old.unionByName(new), reg, reg.by_id(3))


# Generators --------------------------------------------------------------------------------------


@query("SELECT tag, n FROM (VALUES ('#harvest', 50000::BIGINT), ('#regatta', 30000), ('#chess', 12000), ('#lantern', 8000)) v(tag, n) UNION ALL SELECT '#tag' || i, 4 FROM range(50000) t(i)")
def generate_tags(spark, d):
    return generators.skewed_tags(spark).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT 'user:' || (i % 200000) AS user, count(*) AS n FROM range(1000000) t(i) GROUP BY 1")
def generate_users(spark, d):
    return generators.repeated_users(spark).groupBy("user").agg(F.count("*").alias("n"))


@query("SELECT 'event:' || i AS id FROM range(10000) t(i) UNION ALL SELECT 'never:' || i FROM range(100000) t(i)")
def generate_ids(spark, d):
    return generators.prefixed_ids(spark, "event", 10_000).union(generators.prefixed_ids(spark, "never", 100_000))


@query("SELECT i AS \"offset\", i // 3 AS tick FROM range(57) t(i)")
def generate_log(spark, d):
    return generators.rate_log(spark, 19, 3)


def _drawn(rows: int, *seeds: int) -> str:
    """SQL of r(id, u0, u1, ...): the generators' numbers in [0, 1), a seed each."""
    numbers = ", ".join(f"max(h) FILTER (seed = {s}) / 4294967296.0::DOUBLE AS u{k}" for k, s in enumerate(seeds))
    return f"i AS (SELECT id::VARCHAR AS item, id, unnest({list(seeds)}) AS seed FROM range({rows}) t(id)), {hashed('i')}, r AS (SELECT id, {numbers} FROM hashed GROUP BY id)"


@query(f"WITH {_drawn(20_000, 11, 12)} SELECT floor(u0 * 7200)::BIGINT AS ts, ['DE', 'DE', 'DE', 'FR', 'FR', 'ES'][floor(u1 * 6)::INTEGER + 1] AS country FROM r")
def generate_page_views(spark, d):
    return generators.page_views(spark)


@query(f"""WITH {_drawn(50_000, 7, 8, 9)}, w AS (SELECT k, sum(1 / k::DOUBLE) OVER (ORDER BY k) / (SELECT sum(1 / k::DOUBLE) FROM range(1, 2001) t(k)) AS hi FROM range(1, 2001) t(k)),
b AS (SELECT k, coalesce(lag(hi) OVER (ORDER BY k), 0) AS lo, CASE WHEN k = 2000 THEN 1 ELSE hi END AS hi FROM w)
SELECT floor(u1 * 10800)::BIGINT AS ts, 'user-' || floor(u2 * 5000)::BIGINT AS user, 'song-' || lpad(k::VARCHAR, 4, '0') AS song FROM r JOIN b ON u0 >= lo AND u0 < hi""")
def generate_zipf(spark, d):
    return generators.zipf_plays(spark)


@query("SELECT id, row_number() OVER (ORDER BY id) AS place FROM range(1000) t(id)")
def generate_shuffled(spark, d):
    """A shuffle loses and repeats nothing; sorted by its key again, rows have their places."""
    return scan.running_count(generators.shuffled(spark.range(1_000).withColumn("k", F.lit(0)), "id"), "id", "place", ["k"], rows=100).select("id", "place").orderBy("id")
