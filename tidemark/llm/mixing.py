"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, in a seeded shuffled order and repeated as often as the mix may repeat
them, form a stream cut into blocks of equal numbers of words. A van der Corput sequence over
cumulative weights deals the slots of the schedule to the sources; the slots of a source are ranked
by position, and the slot of rank r takes the source's block r. With 2^m slots the sequence's points
are a permutation of the grid, so a source with n grid cells gets exactly n slots, spread evenly.

DataFrame operations only. The text is read once, for its number of words; all that follows runs on
narrow rows. No window spans a source: sums and ranks are taken inside short runs of the order and
added to the sums before each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, words_native

#: The contract's weights by position of the source in code point order.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_TOKENS = 1024
SEED = "mix"
#: Documents, or slots, of a source that are ordered together in one window.
RUN = 1024


def document_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """One narrow row per document; `row` tells rows apart that are equal in all else."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        words_native(F.col(text_col)).alias("size"), key.alias("shuffled"), F.monotonically_increasing_id().alias("row"),
    )


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, take): one row per source.

    Sources in code point order, null last, weigh `weights` in turn and share the words of all. A
    target stops at max_repeats times its source's size and the excess is reshared by weight until
    none is above: the level at which sum(min(level * weight, cap)) is the total. Sources in order of
    cap / weight reach their caps first, so the level follows from running sums. `take` is the target
    in whole words. The windows are over the table of sources, one short row each.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1)
    table = table.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeats).cast("double").alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    table = table.select(
        "*", F.sum("source_size").over(all_rows).cast("double").alias("total"), F.sum("weight").over(all_rows).alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    # The first source in this order whose share at its level is within its cap ends the capped ones.
    table = table.withColumn("own_level", level).withColumn("fits", F.col("own_level") * F.col("weight") <= F.col("cap"))
    table = table.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "own_level"))).over(all_rows)["own_level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return table.select("source", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("take"))


def _ranked(frame: DataFrame, groups: list, run: Column, order: list, value: Column, out: str) -> DataFrame:
    """Adds `out`, the sum of value over the rows before this one in its group, without a window over a group.

    run: numbers the runs of a group, in the rows' order. Runs are summed in runs of RUN themselves.
    """
    frame = frame.withColumn("_run", run.cast("long")).withColumn("_value", value)
    runs = frame.groupBy(*groups, "_run").agg(F.sum("_value").alias("_sum")).withColumn("_far", F.floor(F.col("_run") / RUN))
    back = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    far = runs.groupBy(*groups, "_far").agg(F.sum("_sum").alias("_all"))
    far = far.select(*groups, "_far", F.coalesce(F.sum("_all").over(back(*groups, by="_far")), F.lit(0)).alias("_before"))
    near = runs.select(*groups, "_run", "_far", F.coalesce(F.sum("_sum").over(back(*groups, "_far", by="_run")), F.lit(0)).alias("_near"))
    inner = Window.partitionBy(*groups, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    frame = frame.withColumn("_inner", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    kept = [c for c in frame.columns if c not in ("_run", "_value", "_inner")]
    # One after the other: the join of two tables of runs would look larger to the planner than the rows it is for.
    near, far = near.toDF(*[f"_near_{c}" for c in near.columns]), far.toDF(*[f"_far_{c}" for c in far.columns])
    frame = frame.join(near, [F.col(c).eqNullSafe(F.col(f"_near_{c}")) for c in (*groups, "_run")])
    frame = frame.join(far, [F.col(f"_near_{c}").eqNullSafe(F.col(f"_far_{c}")) for c in (*groups, "_far")])
    return frame.select(*kept, (F.col("_inner") + F.col("_near__near") + F.col("_far__before")).cast("long").alias(out))


def schedule(scratch: Scratch, targets: DataFrame, block_tokens: int) -> DataFrame:
    """(source, rank, position): the slots of each source, ranked by their position in the mix.

    A source has ceil(take / block_tokens) cells of a grid of 2^m, so that many van der Corput points.
    """
    cells = targets.select("source", F.ceil(F.col("take") / block_tokens).cast("long").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))
    cells = cells.withColumn("bits", F.greatest(F.lit(1), F.ceil(F.log2(F.sum("n").over(Window.partitionBy()).cast("double")))).cast("int"))
    # Two explodes, dealt out between them, so that no task makes all slots of a large source.
    parts = cells.where("n > 0").select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")).alias("part"))
    parts = parts.repartition(F.col("source"), F.col("part"))
    cell = F.explode(F.expr(f"sequence(part * {RUN}, least(n, (part + 1) * {RUN}) - 1)"))
    slots = parts.select("source", "bits", "first", cell.alias("cell"))
    point = F.conv(F.reverse(F.lpad(F.bin(F.col("first") + F.col("cell")), F.col("bits"), F.lit("0"))), 2, 10).cast("long")
    slots = scratch.write(slots.select("source", point.alias("position")), "slots")  # so that their number is known
    return _ranked(slots, ["source"], F.floor(F.col("position") / RUN), ["position"], F.lit(1), "rank")


def mix_sources(
    docs: DataFrame, weights: tuple = WEIGHTS, block_tokens: int = BLOCK_TOKENS, max_repeats: int = MAX_REPEATS,
    seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(documents, segments).

    documents: doc_id, row, size, source, source_size, target, taken; one row per input row. segments:
    source, position (of the slot in the mix), rank, start (word of the source's repeated stream),
    passage (of the document in it), doc_id, row, words; the mix itself, in order of (position, start).

    Null or empty texts have size 0, a null source is a source, rows of equal id are separate
    documents, an empty table gives empty results; other columns are ignored. If all sizes are 0 so
    are all targets. Each source's taken words are its target rounded, and a document's are at most
    max_repeats times its size.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.write(document_sizes(docs, id_col, text_col, source_col, seed), "sizes")
    targets = scratch.write(source_targets(sizes, weights, max_repeats), "targets")
    # Runs of the shuffled order: as many per source as give about RUN documents if all were of one source.
    digits, rows = 1, sizes.count()
    while 16**digits * RUN < rows and digits < 8:
        digits += 1
    run = F.conv(F.substring("shuffled", 1, digits), 16, 10)
    placed = _ranked(sizes, ["source"], run, ["shuffled", "doc_id", "row"], F.col("size"), "place")
    slim = targets.withColumnRenamed("source", "_source")
    placed = placed.join(slim, placed["source"].eqNullSafe(slim["_source"])).drop("_source")
    placed = scratch.write(placed.select("doc_id", "row", "size", "source", "source_size", "target", "take", "place"), "placed")
    # Each time the stream passes a document; then the blocks that the passage meets.
    passage = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("passage")
    passages = placed.where("size > 0").select("doc_id", "row", "source", "source_size", "size", "take", "place", passage)
    passages = passages.withColumn("start", F.col("place") + F.col("passage") * F.col("source_size")).where("start < take")
    passages = passages.withColumn("end", F.least(F.col("start") + F.col("size"), F.col("take")))
    block = F.explode(F.expr(f"sequence(start div {block_tokens}, (end - 1) div {block_tokens})")).alias("rank")
    blocks = passages.select("doc_id", "row", "source", "passage", "start", "end", block)
    first = F.greatest("start", F.col("rank") * block_tokens)
    blocks = blocks.select("doc_id", "row", "source", "passage", "rank", first.alias("start"), (F.least("end", (F.col("rank") + 1) * block_tokens) - first).alias("words"))
    slots = schedule(scratch, targets, block_tokens).withColumnsRenamed({"source": "_source", "rank": "_rank"})
    segments = blocks.join(slots, blocks["source"].eqNullSafe(slots["_source"]) & (blocks["rank"] == slots["_rank"])).drop("_source", "_rank")
    segments = scratch.write(segments, "segments")
    scratch.keep(placed, segments)
    columns = ["doc_id", "row", "size", "source", "source_size", "target"]
    none = segments.select("doc_id", "row", *[F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in columns[2:]], "words")
    summed = placed.select(*columns, F.lit(0).cast("long").alias("words")).unionByName(none).groupBy("row").agg(
        *[F.max(c).alias(c) for c in columns if c != "row"], F.sum("words").alias("taken"))
    return summed.select("doc_id", "row", "size", "source", "source_size", "target", "taken"), segments


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, nulls, empties and repeats as in mix_sources."""
    documents, _ = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, position: str = "position") -> DataFrame:
    """docs, each row as often as the mix takes its words, to the nearest whole number, with its place in the mix's order.

    position: that of the slot in which the copy's passage begins (of the last one, if the mix takes fewer);
    null for rows without a word, which are of no source's words and stay once. Null ids and sources are
    like others, rows that share id, source and text share what the mix takes of them and its places, an empty table stays
    empty; columns are kept whatever their names, except that one of the name of `position` is replaced.
    """
    columns = [c for c in docs.columns if c != position]
    mark, copy, id_, taken_mark, starts = fresh(docs, "_mark", "_copy", "_id", "_taken", "_starts")
    ident = F.xxhash64("doc_id", "source", "text")
    taken, segments = mix_sources(docs.select(F.struct("doc_id", ident.alias("mark")).alias("doc_id"), "source", "text"))
    # One row a passage's block beside one a document, so that they meet in a group and not in a join.
    blank = F.lit(None).cast("long")
    both = taken.select("doc_id", "taken", "size", F.lit(None).cast("int").alias("passage"), blank.alias("position"))
    both = both.unionByName(segments.select("doc_id", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("size"), "passage", "position"))
    first = F.array_compact(F.array(*[F.min(F.when(F.col("passage") == e, F.col("position"))) for e in range(MAX_REPEATS)]))
    taken = both.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), first.alias("starts"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    places = F.expr("transform(sequence(0, greatest(times, 1) - 1), k -> element_at(starts, least(k, size(starts) - 1) + 1))")
    taken = taken.withColumn("times", times).where("times > 0")
    taken = taken.select(F.col("doc_id.doc_id").alias(id_), F.col("doc_id.mark").alias(taken_mark), F.when(F.size("starts") > 0, places).otherwise(F.array(F.lit(None).cast("long"))).alias(starts))
    taken = Scratch(docs.sparkSession, "mix").write(taken, "times")
    marked = docs.withColumn(mark, ident)
    copied = marked.join(taken, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(taken_mark)))
    return copied.withColumn(copy, F.explode(starts)).select(*[F.col(f"`{c}`") for c in columns], F.col(copy).alias(position))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """mix_documents without the position: the packing that follows deals documents out by their lengths."""
    (position,) = fresh(docs, "_position")
    return mix_documents(docs, position).drop(position)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS shuffled
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight,
         (source_size * 3)::DOUBLE AS cap FROM s),
r AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(cap) OVER o, 0.0) AS cap_before, coalesce(sum(weight) OVER o, 0.0) AS weight_before
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - cap_before) / (all_weight - weight_before) AS own_level FROM r),
t AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT own_level FROM l WHERE own_level * weight <= cap ORDER BY cap / weight, own_level LIMIT 1) * weight, cap)) AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS take,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY shuffled, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(place + size, take) - place) + greatest(0, least(place + size + source_size, take) - place - source_size)
        + greatest(0, least(place + size + 2 * source_size, take) - place - 2 * source_size))::BIGINT AS taken
FROM p
"""
