"""Loading the input tables: pruned, pushed-down Parquet scans, with schemas remembered by path."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_SCHEMAS: dict[str, StructType] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; the schema is read from a footer once a path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def run_sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL over the input tables that ``text`` names (as ``{orders}``) and further frames."""
    named = {t: load(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text)) & set(TABLES)}
    return spark.sql(text, **named, **frames)
