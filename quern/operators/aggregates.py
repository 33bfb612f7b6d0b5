"""Aggregation: partial and final hash aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import json as J
from quern.functions import numbers as N
from quern.functions.registry import Aggregate, Functions
from quern.registry import operator, sql_operator
from quern.tables import load

sql_operator("agg_global", "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, round(avg(o_totalprice), 4) AS mean FROM {orders}")
sql_operator("agg_global_empty", "SELECT count(*) AS n, min(o_orderkey) AS lo, sum(o_totalprice) AS s FROM {orders} WHERE o_orderkey < 0")
sql_operator("agg_group_by", "SELECT s, count(*) AS n FROM (SELECT nullif(o_orderstatus, 'F') AS s FROM {orders}) t GROUP BY s")
sql_operator("agg_group_by_ordinal", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM {orders} GROUP BY 1, 2")
sql_operator("agg_group_by_alias", "SELECT year(o_orderdate) AS y, count(*) AS n FROM {orders} GROUP BY y", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY y")
sql_operator("agg_having", "SELECT c_nationkey FROM {customer} GROUP BY c_nationkey HAVING count(*) > 60 AND max(c_acctbal) > 9000")
sql_operator("agg_expr_of_agg", "SELECT o_orderstatus, round(max(o_totalprice) / avg(o_totalprice), 6) AS r, count(*) + 1 AS n FROM {orders} GROUP BY o_orderstatus")
sql_operator("agg_count_star", "SELECT count(*) AS n FROM {lineitem}")
sql_operator("agg_count", "SELECT count(nullif(o_orderstatus, 'F')) AS n FROM {orders}")
sql_operator("agg_sum", "SELECT l_returnflag, sum(l_linenumber) AS n, round(sum(l_extendedprice), 2) AS p FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS p FROM lineitem GROUP BY l_returnflag")
sql_operator("agg_avg", "SELECT l_linestatus, round(avg(l_quantity), 6) AS a FROM {lineitem} GROUP BY l_linestatus")
sql_operator("agg_min", "SELECT c_mktsegment, min(c_acctbal) AS lo, min(c_name) AS first FROM {customer} GROUP BY c_mktsegment")
sql_operator("agg_max", "SELECT c_mktsegment, max(c_acctbal) AS hi, max(c_name) AS last FROM {customer} GROUP BY c_mktsegment")
sql_operator("agg_distinct", "SELECT count(DISTINCT l_suppkey) AS s, count(DISTINCT l_returnflag, l_linestatus) AS g, sum(DISTINCT l_linenumber) AS n FROM {lineitem}", "SELECT count(DISTINCT l_suppkey) AS s, count(DISTINCT (l_returnflag, l_linestatus)) AS g, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS n FROM lineitem")
sql_operator("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, max(o_totalprice) FILTER (WHERE o_custkey < 500) AS m FROM {orders} GROUP BY o_orderpriority")
sql_operator(
    "agg_group_concat",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_nationkey) AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
)


@operator("agg_total", "SELECT o_orderstatus, CAST(coalesce(sum(CASE WHEN o_custkey < 0 THEN o_totalprice END), 0) AS DOUBLE) AS t FROM orders GROUP BY o_orderstatus")
def agg_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return orders.groupBy("o_orderstatus").agg(N.total(F.when(F.col("o_custkey") < 0, F.col("o_totalprice"))).alias("t"))


@operator("agg_bare_column", "SELECT o_custkey, min(o_orderkey) AS k, arg_min(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey")
def agg_bare_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"), F.min_by("o_orderstatus", "o_orderkey").alias("s"))


@operator("agg_json_group_array", "SELECT n_regionkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey")
def agg_json_group_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(J.group_array(F.col("n_nationkey"), F.col("n_nationkey")).alias("j"))


@operator("agg_json_group_object", """SELECT n_regionkey, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_nationkey) || '}' AS j FROM nation GROUP BY n_regionkey""")
def agg_json_group_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.transform(rows, lambda r: F.struct(r["n_name"], r["n_nationkey"])))).alias("j"))


@operator("agg_udaf", "SELECT o_orderpriority, max(o_totalprice) - min(o_totalprice) AS spread, count(DISTINCT o_custkey % 7) AS kinds FROM orders GROUP BY o_orderpriority")
def agg_udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two user aggregates of a step and a final function; tasks fold their rows, and states are merged."""
    functions = Functions(spark)

    def wider(s, x):
        return s if x is None else [x, x] if s is None else [min(s[0], x), max(s[1], x)]

    functions.aggregate("spread", Aggregate(lambda: None, wider, lambda a, b: a if b is None else b if a is None else [min(a[0], b[0]), max(a[1], b[1])], lambda s: None if s is None else s[1] - s[0], "double"))
    functions.aggregate("kinds", Aggregate(set, lambda s, x: s if x is None else s | {x}, lambda a, b: a | b, len, "bigint"))
    orders = load(spark, sf_dir, "orders").withColumn("kind", F.col("o_custkey") % 7)
    return functions.grouped(orders, ["o_orderpriority"], spread=("spread", "o_totalprice"), kinds=("kinds", "kind"))
