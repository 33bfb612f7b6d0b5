"""Set operations, common table expressions and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.recursion import fixpoint
from quern.registry import operator, sql_operator
from quern.tables import load

_C, _S = "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 5000 AND c_nationkey < 20", "SELECT s_nationkey AS k FROM {supplier} WHERE s_nationkey > 4"
sql_operator("set_union_all", f"{_C} UNION ALL {_S}")
sql_operator("set_union", f"{_C} UNION {_S}")
sql_operator("set_intersect", f"{_C} INTERSECT {_S}")
sql_operator("set_except", f"{_C} EXCEPT {_S}")
sql_operator("set_chain", f"(({_C} UNION {_S}) INTERSECT SELECT n_nationkey FROM {{nation}} WHERE n_nationkey > 7) EXCEPT SELECT 12")
sql_operator("cte_simple", "WITH t AS (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0) SELECT count(*) AS n FROM t")
sql_operator("cte_multi", "WITH a AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), b AS (SELECT n, count(*) AS m FROM a GROUP BY n) SELECT n, m FROM b")
sql_operator("cte_columns", "WITH a(k, v) AS (SELECT n_regionkey, count(*) FROM {nation} GROUP BY n_regionkey) SELECT k, v FROM a")
sql_operator("cte_materialized", "WITH a AS (SELECT o_custkey, max(o_totalprice) AS m FROM {orders} GROUP BY o_custkey) SELECT x.o_custkey FROM a x JOIN a y ON x.o_custkey = y.o_custkey WHERE x.m > 250000", "WITH a AS MATERIALIZED (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) SELECT x.o_custkey FROM a x JOIN a y ON x.o_custkey = y.o_custkey WHERE x.m > 250000")
sql_operator("cte_dml", "WITH gone AS (SELECT r_regionkey FROM {region} WHERE r_regionkey > 2) SELECT n_nationkey FROM {nation} WHERE n_regionkey NOT IN (SELECT r_regionkey FROM gone)")
sql_operator("subq_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * CAST(1.5 AS DOUBLE) FROM orders)")
sql_operator("subq_correlated", "SELECT o.o_orderkey FROM {orders} o WHERE o.o_totalprice = (SELECT max(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
sql_operator("cte_recursive_sql", "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 60) SELECT n FROM s")


@operator("cte_recursive", "WITH RECURSIVE s(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM s WHERE n < 15) SELECT n, f FROM s")
def cte_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixpoint without a level cap: every round works on the last one's rows."""
    return fixpoint(spark.sql("SELECT 1 AS n, CAST(1 AS BIGINT) AS f"), lambda w: w.where("n < 15").selectExpr("n + 1 AS n", "f * (n + 1) AS f"))


@operator("view_create", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority")
def view_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").createOrReplaceTempView("quern_open_orders")
    return spark.table("quern_open_orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@operator("view_drop", "SELECT 1 AS dropped, 0 AS again")
def view_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "region").createOrReplaceTempView("quern_gone")
    first, again = spark.catalog.dropTempView("quern_gone"), spark.catalog.dropTempView("quern_gone")
    return spark.range(1).select(F.lit(int(first)).alias("dropped"), F.lit(int(again)).alias("again"))
