"""Near-duplicates by SimHash: fingerprints at Hamming distance 2 or less are linked.

Pivot distance tables. Distinct fingerprints meet in cells where two of their four 16-bit blocks agree:
at most two bits differ, so two blocks at least are untouched, and no linked pair is missed. In a cell
the distances of each fingerprint to the pivots are tabled and sorted; a pair whose distances to any
pivot differ by more than 2 is discarded (the triangle inequality), and survivors are verified bit by
bit. A crowded cell is split the same way by its 32 free bits, and again by the 16 then free, after
which no cell has more than 256 fingerprints: every pair is found by the same tables, and no list grows
with the input. A cell hands on a spanning star for each of its connected parts, so what it makes is
no more than its members.

The pipeline's stage links texts whose sets of five-word shingles are similar (Jaccard) to 0.8 or
more. It takes the SimHash of each set and links fingerprints by the same tables; a set stands for those
of its fingerprint, and every link is verified on the whole sets. Pairs at 0.8 are about ten bits apart,
most of them too far for SimHash at any radius that is not quadratic, so a second search adds what
it does not reach: MinHash, BANDS bands of BAND_ROWS values, of which a pair at 0.8 shares none with a
chance of (1 - 0.8 ** 5) ** 32 = 3e-6, a closer pair less. Its candidates are verified in the same way. In a
bucket each set is compared with the smallest and the greatest, and then, where that and SimHash do not
make the bucket one component, each with all of the other components, inside the bucket, which hands
on one edge for each two components that it joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, without_rows

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Reference fingerprints: rows of the 64 x 64 Hadamard matrix, far from each other, so distances to them are little correlated.
PIVOTS = np.array([sum(((i & j).bit_count() & 1) << j for j in range(64)) for i in range(0, 64, 2)], np.uint64)
#: Distinct fingerprints of a cell that are compared by their table; the cells of more are split.
BUCKET = 256
#: Blocks of a split, and splits: after the last, 8 bits are free, so a cell has 256 fingerprints at most.
BLOCKS, LEVELS = 4, 3
_CHUNK = 1 << 15
#: The stage's shingles and least similarity, and its search beyond SimHash.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 32, 5
#: Sets of a bucket that are compared in one place; larger buckets are compared part by part.
PART = 512
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * BAND_ROWS), dtype=np.uint64)
_TIMES, _PLUS, _MIX = _DRAWN[0] | np.uint64(1), _DRAWN[1], _DRAWN[2].reshape(BANDS, BAND_ROWS) | np.uint64(1)


def _spans(words: list[bytes], shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined, and where each shingle starts and ends in them."""
    joined = b" ".join(words)
    if len(words) <= shingle:
        starts, ends = [0], [len(joined)]
    else:
        stops = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *stops[:-shingle].tolist()]
        ends = (stops[shingle - 1 :] - 1).tolist()
    return joined, starts, ends


def majority(parts: Iterable[np.ndarray]) -> int:
    """64 bits; a bit is 1 if set in over half the hashes of all parts."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
        n += len(hashes)
    return int(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is 1 if set in over half the hashes of the shingles, repeats included. No word: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, starts, ends = _spans(words, shingle)
    digest = xxhash.xxh64_intdigest
    parts = (zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK]) for at in range(0, len(starts), _CHUNK))
    return majority(np.array([digest(joined[a:b], seed) for a, b in part], np.uint64) for part in parts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, fp): mark tells texts of one id apart, fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(values)], ["doc_id", "mark", "fp"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, mark long, fp long")


def close_pairs(values: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs within the distance: pivot table, maximum coordinate difference, verification. Equal values are pairs, too."""
    table = np.bitwise_count(values[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    first, left, right = table[order, 0], [], []
    # By the first coordinate, a value's possible partners stand next to it.
    stop = np.searchsorted(first, first + distance, side="right")
    for i in range(len(order) - 1):
        near = np.arange(i + 1, stop[i])
        if len(near):
            a, b = order[i], order[near]
            b = b[np.abs(table[b] - table[a]).max(axis=1) <= distance]
            b = b[np.bitwise_count(values[b] ^ values[a]) <= distance]
            left.append(np.full(len(b), a))
            right.append(b)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each bucket, each member of a connected part with the part's smallest."""
    for batch in batches:
        out_a, out_b = [], []
        for members in batch["members"]:
            values = np.sort(np.asarray(members, np.int64))
            left, right = close_pairs(values.view(np.uint64))
            root = np.arange(len(values))
            moved = len(left) > 0
            while moved:
                low = np.minimum(root[left], root[right])
                before = root.copy()
                np.minimum.at(root, left, low)
                np.minimum.at(root, right, low)
                root = root[root]
                moved = bool((root != before).any())
            linked = np.flatnonzero(root != np.arange(len(values)))
            out_a.append(values[linked])
            out_b.append(values[root[linked]])
        if out_a:
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def finer(mask: int) -> list[int]:
    """The mask with two of the four equal parts of its free bits added, in the six ways."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = [sum(1 << b for b in free[k * len(free) // BLOCKS : (k + 1) * len(free) // BLOCKS]) for k in range(BLOCKS)]
    return [mask | parts[i] | parts[j] for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(scratch: Scratch, distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of `distinct.fp` within two bits.

    An empty table has none; fp is distinct and not null.
    """
    rows, masks, edges = distinct.select("fp", F.lit(0).cast("long").alias("mask")), [0], None
    for level in range(LEVELS):
        ways = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in finer(m)]))])
        rows = rows.select("fp", F.explode(F.element_at(ways, F.col("mask"))).alias("mask"))
        rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        if level:
            rows = scratch.write(rows.distinct(), "cells")  # of crowded cells only
        masks = sorted({f for m in masks for f in finer(m)})
        last = level == LEVELS - 1
        # A limit of bucket + 1 rows a key, applied before the shuffle too, tells crowded cells without gathering them.
        rank = F.row_number().over(Window.partitionBy("mask", "key").orderBy("fp"))
        seen = rows if last else rows.withColumn("rank", rank).where(F.col("rank") <= bucket + 1)
        cells = scratch.write(seen.groupBy("mask", "key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1), "buckets")
        found = cells.where(F.lit(last) | (F.size("members") <= bucket)).select("members").mapInPandas(_stars, "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        crowded = cells.where(F.size("members") > bucket).select("mask", "key")
        if last or crowded.isEmpty():
            break
        rows = rows.join(crowded, ["mask", "key"], "left_semi").select("fp", "mask")
    return edges


def shingle_set(text: str | None, shingle: int = STAGE_SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; a text of fewer words is one shingle. No word: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, starts, ends = _spans(words, shingle)
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(joined[a:b], seed) for a, b in zip(starts, ends)}), np.uint64)


def band_keys(members: np.ndarray) -> np.ndarray:
    """One key a band; two sets have a band's key in common if its BAND_ROWS smallest values are the same."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), 4096):
        np.minimum(least, (members[at : at + 4096, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return (least.reshape(BANDS, BAND_ROWS) * _MIX).sum(axis=1, dtype=np.uint64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, mark, fp, n, simhash, bands): fp is a hash of the whole set of shingles, n its size, simhash its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            prints = [majority(s[at : at + _CHUNK] for at in range(0, len(s), _CHUNK)) for s in sets]
            bands = pa.array([band_keys(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(fp), pa.array([len(s) for s in sets], pa.int32())]
            columns += [pa.array(np.array(prints, np.uint64).view(np.int64)), bands]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "fp", "n", "simhash", "bands"])

    slim = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, mark long, fp long, n int, simhash long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(fp, members): the sets of the texts that `wanted` (fp, _id, _mark) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), sets], ["fp", "members"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    return texts.select("fp", "text").mapInArrow(run, "fp long, members array<long>").dropDuplicates(["fp"])


def bucket_edges(sets: list[np.ndarray], root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Positions of similar sets, one pair for each two components that they join."""
    n = np.array([len(x) for x in sets])
    starts = np.cumsum(n) - n
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    root, found = root.copy(), []
    for i in range(len(sets)):
        others = np.flatnonzero((root != root[i]) & (np.minimum(n, n[i]) / np.maximum(n, n[i]) >= similarity))
        others = others[others > i]
        if not len(others):
            continue
        mine = np.zeros(len(names), np.int32)
        mine[flat[starts[i] : starts[i] + n[i]]] = 1
        if 8 * len(others) < len(sets):
            both = np.array([mine[flat[starts[j] : starts[j] + n[j]]].sum() for j in others])
        else:
            both = np.add.reduceat(mine[flat], starts)[others]
        for j in others[both / (n[i] + n[others] - both) >= similarity]:
            if root[j] != root[i]:
                found.append((i, int(j)))
                root[root == root[j]] = root[i]
    return found


def simhash_pairs(scratch: Scratch, distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(end, other), each (fp, n): the sets that SimHash links, to be verified.

    Of the sets of one fingerprint that of the smallest fp stands for all: each is paired with it, and those that stand
    for linked fingerprints with each other. The empty set has no pairs.
    """
    marked = distinct.where("n > 0").select("simhash", F.struct("fp", "n").alias("end"))
    heads = scratch.write(marked.groupBy("simhash").agg(F.min("end").alias("head")), "heads")
    near = links(scratch, heads.select(F.col("simhash").alias("fp")), bucket)
    left, right = (heads.select(F.col("simhash").alias(c), F.col("head").alias(name)) for c, name in (("a", "end"), ("b", "other")))
    far = near.join(left, "a").join(right, "b").select("end", "other")
    same = marked.join(heads, "simhash").select("end", F.col("head").alias("other")).where("end.fp <> other.fp")
    return scratch.write(same.unionByName(far), "simhash")


def similar_links(scratch: Scratch, docs: DataFrame, distinct: DataFrame, shingle: int, similarity: float, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of `distinct.fp` that are similar and share a band, or that SimHash links."""
    near = simhash_pairs(scratch, distinct, bucket)
    rows = distinct.select("fp", "n", F.explode("bands").alias("key"))
    ends = rows.groupBy("key").agg(F.min(F.struct("fp", "n")).alias("low"), F.max(F.struct("fp", "n")).alias("high")).where("low.fp <> high.fp")
    shared = scratch.write(rows.join(ends, "key"), "shared")
    needed = shared.select("fp").union(near.select("end.fp")).union(near.select("other.fp")).distinct()
    wanted = distinct.join(needed, "fp", "left_semi").select("fp", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"))
    sets = scratch.write(sets_of(docs, scratch.write(wanted, "wanted"), shingle), "sets")
    star = shared.select(F.explode(F.array("low", "high")).alias("end"), F.struct("fp", "n").alias("other")).where("end.fp <> other.fp").unionByName(near)
    # Sets that differ more in size cannot be similar.
    star = star.where(F.least("end.n", "other.n") / F.greatest("end.n", "other.n") >= similarity)
    star = scratch.write(star.select(F.least("end.fp", "other.fp").alias("a"), F.greatest("end.fp", "other.fp").alias("b")).distinct(), "star")
    left, right = (sets.select(F.col("fp").alias(c), F.col("members").alias(f"of_{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    checked = star.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("n"))
    edges = scratch.write(checked.where(F.col("both") / (F.col("n") - F.col("both")) >= similarity).select("a", "b"), "similar")
    labels = connected_components(scratch, edges).withColumnRenamed("node", "fp")
    rooted = scratch.write(shared.select("key", "fp").join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size")).where("least <> most")
    members = rooted.join(open_keys.select("key", F.ceil(F.col("size") / PART).cast("int").alias("parts")), "key").join(sets, "fp")
    # Each part of a bucket meets each other part, and itself.
    members = members.withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int")).withColumn("with", F.explode(F.expr("sequence(0, parts - 1)")))
    buckets = members.groupBy("key", F.least("own", "with").alias("part"), F.greatest("own", "with").alias("other"))
    buckets = buckets.agg(F.collect_list(F.struct("fp", "root", "members")).alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch.column("bucket"):
                of = bucket.values
                fp, root = (of.field(c).to_numpy(zero_copy_only=False) for c in ("fp", "root"))
                got = np.array(bucket_edges([x.values.to_numpy() for x in of.field("members")], root, similarity), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(fp[got[:, 0]]), pa.array(fp[got[:, 1]])], ["a", "b"])

    return edges.unionByName(scratch.write(buckets.select("bucket").mapInArrow(run, "a long, b long"), "rest"))


def similar_groups(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """As near_groups, by SimHash and MinHash, linking texts whose sets of shingles are similar; fp is a hash of the set.

    Texts without a word have the same empty set.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    prints = scratch.write(sketches(docs, shingle), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark")).alias("first")
    distinct = scratch.write(prints.groupBy("fp").agg(first, F.min("n").alias("n"), F.min("simhash").alias("simhash"), F.min("bands").alias("bands")), "distinct")
    return _components(scratch, prints, distinct, similar_links(scratch, docs, distinct, shingle, similarity))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, mark, fp, component_id, kept): one row per input row.

    component_id: the smallest id reachable by links. Null and empty texts have fingerprint 0, linked
    like any other. Rows of one id are separate documents; null ids are never a component's id unless
    it has no other. kept: the rows of the component's first document (smallest id, then mark).
    Empty tables give empty results; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, id_col, text_col, shingle), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark")).alias("first")
    distinct = scratch.write(prints.groupBy("fp").agg(first), "distinct")
    return _components(scratch, prints, distinct, links(scratch, distinct, bucket))


def _components(scratch: Scratch, prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, component_id, kept) of the rows whose fingerprints the edges link."""
    labels = connected_components(scratch, edges)
    rooted = scratch.write(distinct.join(labels.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first"), "rooted")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    linked = scratch.write(rooted.join(best, "root").select("fp", "best"), "linked")
    table = distinct.join(linked, "fp", "left").select("fp", F.coalesce("best", "first").alias("best"))
    table = scratch.write(table.select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.mark").alias("best_mark")), "components")
    scratch.keep(prints, table)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("best_mark"))
    return prints.join(table, "fp").select("doc_id", "mark", "fp", "component_id", kept.alias("kept"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_groups of all documents, nulls, empties and repeats as there."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, that of the smallest id; all columns kept, whatever their names.

    Null, empty and blank texts are one group. Null ids come last. Of rows that share id and text one stays. An empty table
    stays empty.
    """
    groups = similar_groups(docs).groupBy("doc_id", "mark").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    groups = Scratch(spark, "simhash").write(groups, "groups")
    repeated = not groups.where("kept and n > 1").isEmpty()
    return without_rows(docs, F.xxhash64("text"), groups.where("not kept").select("doc_id", "mark"), repeated)
