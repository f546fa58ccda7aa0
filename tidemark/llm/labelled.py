"""A bounded sample of labelled documents, for operators that learn from labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted on, at most: those of smallest hash, so any label is as likely.
SAMPLE_ROWS = 20_000


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for documents whose labels must not be learned from; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most `rows` labelled documents outside the fold. Several labels of one id count as the largest.

    Rows of one id are all taken; null ids and labels are not. Ids may be of any type.

    The chosen ids are a table of at most `rows` short rows, which is what makes their broadcast safe.
    """
    kind = labels.schema["doc_id"].dataType.simpleString()
    known = labels.where(~held_out(F.col("doc_id"), folds, fold) & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.label) for r in chosen.collect()], f"_id {kind}, label int")
    return docs.select(F.col("doc_id").alias("_doc"), F.col("text")).join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select("text", "label")
