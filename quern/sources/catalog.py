"""Catalog views as DataFrames: the system table, statistics, and column information."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def master(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(type, name, tbl_name, n_columns) of each table."""
    return spark.createDataFrame([("table", t, t, len(df.columns)) for t, df in tables.items()], "type string, name string, tbl_name string, n_columns long")


def statistics(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, n_columns, payload): rows, columns, and bytes of the texts and binaries."""
    parts = []
    for t, df in tables.items():
        sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
        payload = F.coalesce(F.sum(reduce(lambda a, b: a + b, sizes, F.lit(0)).cast("long")), F.lit(0))
        parts.append(df.agg(F.count("*").alias("n_rows"), payload.alias("payload")).select(F.lit(t).alias("name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), "payload"))
    return reduce(DataFrame.unionAll, parts)


def table_info(spark: SparkSession, df: DataFrame, primary: list[str] | None = None) -> DataFrame:
    """(cid, name, type, notnull, pk) of each column."""
    rows = [(i, f.name, f.dataType.simpleString(), 0 if f.nullable else 1, (primary or []).index(f.name) + 1 if f.name in (primary or []) else 0) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "cid int, name string, type string, notnull int, pk int")
