"""Running sums and row numbers over a whole table's order, without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.shared import shared_table

#: Parts whose totals one task sums up.
LEVEL = 10_000


def running(df: DataFrame, order: list[str | Column], sums: dict[str, str] | None = None, number: str | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``number``, the row's place from 1, and for every name in ``sums`` the running sum of that column, over ``order``.

    Rows are dealt by ranges of the order to ``parts`` (as many as shuffles have), which are numbered in that order and written once;
    each part is summed up by itself, and the totals of the parts before it are added.  The totals are a row a part, summed up
    in two levels.  Equal rows of the order are in one part, so an order that is unique also spreads a value that a third of the rows share.
    """
    spark, sums = df.sparkSession, sums or {}
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = shared_table(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    measures = {number: F.lit(1).cast("long")} if number else {}
    measures |= {name: F.col(c) for name, c in sums.items()}
    totals = dealt.groupBy("__part").agg(*[F.sum(c).alias(name) for name, c in measures.items()]).withColumn("__level", F.floor(F.col("__part") / LEVEL))
    levels = totals.groupBy("__level").agg(*[F.sum(name).alias(name) for name in measures])
    zero = F.lit(0)
    above = Window.orderBy("__level").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("__level", *[F.coalesce(F.sum(name).over(above), zero).alias(f"__above_{name}") for name in measures])
    beside = Window.partitionBy("__level").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__part", "__level", *[F.coalesce(F.sum(name).over(beside), zero).alias(f"__beside_{name}") for name in measures])
    bases = bases.join(levels, "__level").select("__part", *[(F.col(f"__above_{name}") + F.col(f"__beside_{name}")).alias(f"__base_{name}") for name in measures])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = dealt.select("*", *[F.sum(c).over(within).alias(f"__inner_{name}") for name, c in measures.items()])
    out = inner.join(bases, "__part")
    return out.select(*df.columns, *[(F.col(f"__base_{name}") + F.coalesce(F.col(f"__inner_{name}"), zero)).alias(name) for name in measures])
