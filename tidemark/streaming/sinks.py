"""Streaming sinks: one that counts again what is sent again, one that does not, and a transactional one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class InjectedCrash(RuntimeError):
    pass


class CrashOnce:
    """Raises in a chosen batch, the first time only, after the sink has written."""

    def __init__(self, batch: int | None):
        self.batch, self.done = batch, False

    def __call__(self, batch_id: int) -> None:
        if self.batch == batch_id and not self.done:
            self.done = True
            raise InjectedCrash(f"after batch {batch_id}")


class CounterSink:
    """Appends every batch it is given: a batch sent again is counted again."""

    def __init__(self, path: str, crash: CrashOnce | None = None):
        self.path, self.crash = path, crash or CrashOnce(None)

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("append").parquet(self.path)
        self.crash(batch_id)

    def total(self, spark: SparkSession) -> int:
        return spark.read.parquet(self.path).count()


class UpsertSink:
    """One row a key: each batch has a folder of its own, overwritten if it is sent again, and readers keep one row a key.

    Writing is idempotent by batch id, reading by key, so neither a batch nor an event sent again counts twice.
    """

    def __init__(self, path: str, key: str, crash: CrashOnce | None = None):
        self.path, self.key, self.crash = path, key, crash or CrashOnce(None)

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        df.dropDuplicates([self.key]).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        self.crash(batch_id)

    def read(self, spark: SparkSession) -> DataFrame:
        """The latest row of each key."""
        rows = spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")
        rest = [c for c in rows.columns if c not in (self.key, "batch")]
        latest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_r")) if rest else rows.select(self.key).distinct()
        return latest.select(self.key, *[F.col("_r")[c].alias(c) for c in rest])

    def total(self, spark: SparkSession) -> int:
        return self.read(spark).count()


class TransactionalSink:
    """Writes a batch aside, then commits it by renaming: readers see all of a batch or none, and each once."""

    def __init__(self, path: str, crash: CrashOnce | None = None):
        self.path, self.crash = path, crash or CrashOnce(None)

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        done, aside = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch_id}"), jvm.org.apache.hadoop.fs.Path(f"{self.path}/_open-{batch_id}")
        fs = done.getFileSystem(conf)
        if not fs.exists(done):
            df.write.mode("overwrite").parquet(aside.toString())
            fs.rename(aside, done)
        self.crash(batch_id)

    def total(self, spark: SparkSession) -> int:
        return spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*").count()


def console(df: DataFrame, checkpoint: str, mode: str = "append", rows: int = 20) -> None:
    """Prints what a stream emits, batch by batch, until its sources are at their end."""
    writer = df.writeStream.format("console").outputMode(mode).option("checkpointLocation", checkpoint).option("numRows", rows).option("truncate", False)
    writer.trigger(availableNow=True).start().awaitTermination()
