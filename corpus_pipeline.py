"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Part of the subpackage tidemark.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import Scratch
from tidemark.llm.exact_dedup import exact_dedup_stage
from tidemark.llm.mixing import mix_stage
from tidemark.llm.packing import packing_stage
from tidemark.llm.simhash import simhash_stage
from tidemark.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mix_stage),
    ("packing", packing_stage),
]

#: Toxicity is learned, SimHash needs XXH64 and packing a tokenizer: tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(before)
    return docs
