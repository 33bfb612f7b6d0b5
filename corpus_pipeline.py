"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import stages
from quern.shared import drop_table, shared_table

STAGES = [
    ("toxicity", stages.toxicity),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("packing", stages.packing),
]

#: A trained classifier and token ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            made = shared_table(out, name)
            drop_table(docs)  # nothing reads the stage before any more
            docs = made
    return out
