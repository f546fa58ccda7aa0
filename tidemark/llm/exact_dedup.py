"""Exact deduplication: group by a 128-bit hash, keep the smallest id, compare bytes inside groups.

The text is read once for its hashes. Rows of groups of one need no more. For the rest, every text is
compared with that of its group's smallest row; texts that differ (a collision of the hash) form new
groups, until no group holds two texts. A group with many rows meets its representative in slices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, without_rows

#: Members of a group that are compared with one copy of its representative.
SLICE = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def hashed(docs: DataFrame, hash_fn: Callable[[Column], Column] = F.md5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, text_sha256, text): what names a row again in a later pass is its id and SHA-256."""
    frame = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    return frame.select("doc_id", hash_fn(F.col("text")).alias("hash"), F.sha2("text", 256).alias("text_sha256"), "text")


def exact_groups(
    docs: DataFrame, hash_fn: Callable[[Column], Column] = F.md5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per input row, dropped ones too.

    Null text counts as empty. Of equal texts the row of the smallest id stays, null ids last; of rows
    with equal text and id, one stays. An empty table gives an empty result; other columns are
    ignored. hash_fn may be weak, even constant per length: groups are by bytes all the same.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    source = hashed(docs, hash_fn, id_col, text_col)
    rows = source.select("doc_id", "hash", "text_sha256", F.monotonically_increasing_id().alias("row"), F.lit(0).alias("version"))
    rows = scratch.write(rows, "rows")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row", "text_sha256")
    version = 0
    while True:
        groups = rows.groupBy("hash", "version").agg(F.min(order).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
        groups = scratch.write(groups.select("hash", "version", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), F.col("keep.text_sha256").alias("keep_sha256"), "group_size"), "groups")
        # Texts of the rows of these groups: one shuffle of the texts, by row; what is written is members only.
        # The join is written before it is grouped, so that AQE can split it where a group is large.
        joined = scratch.write(rows.where(F.col("version") == version).join(groups, ["hash", "version"]), "joined")
        members = joined.groupBy("doc_id", "text_sha256", "hash", "version", "keep_id", "keep_sha256", "group_size").agg(F.min("row").alias("row"))
        members = scratch.write(members.withColumnsRenamed({"doc_id": "_id", "text_sha256": "_sha"}), "members")
        fetched = source.select("doc_id", "text_sha256", "text").join(members, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")))
        first = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_sha") == F.col("keep_sha256"))
        fetched = scratch.write(fetched.select("hash", "group_size", "row", first.alias("first"), "text"), "texts")
        slices = F.floor(F.col("group_size") / SLICE).cast("int")
        ours = fetched.where("not first").select("hash", F.pmod(F.xxhash64("row"), slices + 1).cast("int").alias("slice"), "row", "text")
        kept = fetched.where("first").dropDuplicates(["hash"]).select("hash", F.explode(F.sequence(F.lit(0), slices)).alias("slice"), F.col("text").alias("first_text"))
        other = ours.join(kept, ["hash", "slice"]).where("text <> first_text").select("row").distinct()
        other = scratch.write(other, "other")
        scratch.drop(fetched)
        if other.isEmpty():
            break
        # The rows apart, with those that repeat them, form the hash's next groups.
        apart = members.join(other, "row", "left_semi").select(F.col("_id"), F.col("_sha"), F.lit(True).alias("_apart"))
        moved = rows.join(apart, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")), "left")
        version += 1
        moved = moved.withColumn("version", F.when(F.col("_apart"), version).otherwise(F.col("version")))
        rows = scratch.write(moved.select("doc_id", "hash", "text_sha256", "row", "version"), "rows")
    groups = groups if version == 0 else _all_groups(scratch, rows, order)
    scratch.keep(rows, groups)
    out = rows.join(groups, ["hash", "version"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("keep_row", "row") == F.col("row")).alias("kept"), "text_sha256")


def _all_groups(scratch: Scratch, rows: DataFrame, order: Column) -> DataFrame:
    groups = rows.groupBy("hash", "version").agg(F.min(order).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    return scratch.write(groups.select("hash", "version", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size"), "groups")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_groups of all documents, nulls, empties and repeats as there."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that stay, one for each distinct text, that of the smallest id; all columns kept, whatever their names.

    Null and empty texts are one text. Null ids come last. Of rows that share id and text one stays. An empty table stays empty.
    """
    groups = Scratch(spark, "exact").write(exact_groups(docs), "groups")
    dropped = groups.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    repeated = not dropped.where("kept and n > 1").isEmpty()
    gone = dropped.where("not kept").select("doc_id", "text_sha256")
    return without_rows(docs, F.sha2(normalised(F.col("text")), 256), gone, repeated)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
