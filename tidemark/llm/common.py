"""Helpers the corpus operators share: tables in the shared folder, word patterns, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as every contract of this subpackage defines them.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's spark.checkpoint.dir names it.

    Where that setting is absent a temporary folder is made and set if all runs in one process (local[n]);
    on a cluster it is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors and have known sizes.

    Because a reread table's size is known, Catalyst broadcasts it only below the session's
    threshold, and joins of two such tables are plain exchanges whose skew AQE can split. What no
    returned frame reads is deleted by keep, the rest when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: set[str] = set()

    def _path(self, path: str) -> tuple:
        context = self.spark.sparkContext
        named = context._jvm.org.apache.hadoop.fs.Path(path)
        return named, named.getFileSystem(context._jsc.hadoopConfiguration())

    def write(self, frame: DataFrame, name: str = "t", keep_order: bool = False) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        frame.write.parquet(path)
        if self.count == 1:  # only what is there can be named for deletion
            named, files = self._path(self.root)
            files.deleteOnExit(named)
        table = self.spark.read.schema(frame.schema).parquet(path)
        table._scratch_path = path
        self.paths.add(path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no returned frame reads any more."""
        for path in [t._scratch_path for t in tables]:
            named, files = self._path(path)
            files.delete(named, True)
            self.paths.discard(path)

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables but these."""
        for path in self.paths - {t._scratch_path for t in tables}:
            named, files = self._path(path)
            files.delete(named, True)
        self.paths = {t._scratch_path for t in tables}


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """These names, with as many underscores before them as the frame's columns leave free."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without_rows(docs: DataFrame, ident: Column, gone: DataFrame, repeated: bool) -> DataFrame:
    """docs without the rows of `gone`, a table of (doc_id, ident); one of those that share both, if repeated. Columns as they are."""
    columns = docs.columns
    id_, mark, gone_id, gone_mark = fresh(docs, "_id", "_mark", "_gone_id", "_gone_mark")
    marked = docs.withColumns({id_: F.col("doc_id"), mark: ident})
    gone = gone.toDF(gone_id, gone_mark)
    left = marked.join(gone, F.col(id_).eqNullSafe(F.col(gone_id)) & (F.col(mark) == F.col(gone_mark)), "left_anti")
    if repeated:
        left = left.dropDuplicates([id_, mark])
    return left.select(*[F.col(f"`{c}`") for c in columns])


def words_native(text: Column) -> Column:
    """Number of words of a text, in codegen: each word with the white space behind it becomes one letter."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACE}]+[{SPACE}]*", "x")
    return F.length(F.translate(marked, SPACE_CHARS, "")).cast("long")


def connected_components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node: (node, root) for every node that an edge (a, b) names.

    Hooking and pointer jumping. In each round every tree's root is hooked to the smallest root next
    to it (a min aggregate, combined before the shuffle, so a hub of any degree is harmless), then
    trees are flattened. Each round writes its tables to the shared folder, so joins are of plain
    exchanges and lineage stays short. Ends when no edge joins two trees. Rounds are logarithmic on
    the graphs met in practice; more than `rounds` raises.
    """
    both = scratch.write(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "edges")
    nodes = both.select(F.col("a").alias("node")).union(both.select(F.col("b").alias("node"))).distinct()
    labels = scratch.write(nodes.withColumn("root", F.col("node")), "labels")
    live = both
    for _ in range(rounds):
        left = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        crossing = (
            live.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        following = scratch.write(crossing, "live")
        if live is not both:
            scratch.drop(live)
        live = following
        if live.isEmpty():
            break
        parent = live.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("up"))
        while True:  # flatten the forest of roots
            parent = scratch.write(parent, "parent")
            above = parent.select(F.col("root").alias("up"), F.col("up").alias("upper"))
            if parent.join(above, "up", "left_semi").isEmpty():
                break
            jumped = parent.join(above, "up", "left").select("root", F.coalesce("upper", "up").alias("up"))
            parent = jumped
        moved = labels.join(parent, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        following = scratch.write(moved, "labels")
        scratch.drop(labels)
        labels = following
    else:
        raise RuntimeError("connected components did not settle")
    return labels
