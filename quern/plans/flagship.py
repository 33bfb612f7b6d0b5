"""The flagship plan: scan, pushed filter, partial + final aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.registry import operator


@operator(
    "tpch_pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(round(sum(l_quantity)) AS BIGINT) AS sum_qty,
    round(avg(l_discount), 4) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-12-01' GROUP BY 1, 2""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return (
        lineitem.where(F.col("l_shipdate") <= F.lit("2000-12-01").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity")).cast("bigint").alias("sum_qty"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("n"))
    )
