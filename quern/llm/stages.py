"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what it keeps of ``docs``.

All but the last return the columns of documents, whatever further columns these are and whatever their names.  Rows are kept or
dropped as a whole; substring dedup shortens texts and sets ``n_chars`` anew.  Null texts count as empty, an empty table gives an
empty one.  What becomes of null and repeated ids is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quern.llm import packing as packs
from quern.llm import simhash, substrings
from quern.llm import toxicity as toxic
from quern.llm.common import free_names


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; learnt from the labelled rows among ``docs`` that are not held out.

    Every row is judged by its own text, with or without an id.  Without labelled rows of both classes nothing is rejected.
    """
    model = toxic.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model[0].any():
        return docs
    score = free_names(docs.columns, "score")[0]
    return toxic.scored(docs, model, docs.columns).where(F.col(score) < toxic.THRESHOLD).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every class of near fingerprints; rows without an id stay.

    Rows that share an id are judged each by its own class.  Of those that share both, the one of the least fingerprint stays, then of
    the least hash of its text, then of the least hash of its columns (maps aside).  Texts are told apart by two 64-bit hashes.
    """
    row, chosen = free_names(docs.columns, "__row", "__chosen")
    text = F.coalesce("text", F.lit(""))
    numbered = docs.withColumn(row, F.concat_ws("-", F.xxhash64(text).cast("string"), F.xxhash64(F.lit(1), text).cast("string")))
    classes = simhash.near_classes(numbered, "doc_id", "text", row)
    of_class = classes.where(F.col("doc_id") == F.col("component")).groupBy("doc_id", "class")
    kept = of_class.agg(F.min(F.struct("fp", row)).alias("least")).select("doc_id", F.col(f"least.{row}").alias(row))
    plain = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType)]  # a map has no hash
    one = numbered.join(kept, ["doc_id", row]).groupBy("doc_id", row).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias(chosen))
    return one.select(f"{chosen}.*").unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that one of a smaller id holds; texts that lose nothing stay as they are.

    Rows without an id stay whole, rows that share one are judged each.
    """
    _, removed, _, kept = free_names(docs.columns, *substrings.ADDED)
    text = F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text"))
    out = substrings.dedup(docs).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as of ``op8_packing``; every row is packed, with or without an id."""
    return packs.packed(docs)
