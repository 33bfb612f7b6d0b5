"""Window functions, always over a partition and a unique order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.running import running
from quern.registry import operator, sql_operator
from quern.tables import load

_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
for key, expr in {
    "win_row_number": f"row_number() OVER ({_W})",
    "win_rank": "rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus)",
    "win_dense_rank": "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus)",
    "win_ntile": f"ntile(3) OVER ({_W})",
    "win_partition_by": "count(*) OVER (PARTITION BY o_custkey, o_orderstatus)",
    "win_order_by": "row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)",
    "win_lag": f"lag(o_orderkey, 2, CAST(-1 AS BIGINT)) OVER ({_W})",
    "win_lead": f"lead(o_orderkey) OVER ({_W})",
    "win_first_value": f"first_value(o_orderkey) OVER ({_W} {_ALL})",
    "win_last_value": f"last_value(o_orderkey) OVER ({_W} {_ALL})",
    "win_nth_value": f"nth_value(o_orderkey, 2) OVER ({_W} {_ALL})",
    "win_agg_over": f"sum(o_orderkey) OVER ({_W})",
    "win_frame_rows": f"sum(o_orderkey) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)",
    "win_frame_range": "count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING)",
}.items():
    sql_operator(key, f"SELECT o_orderkey, CAST({expr} AS BIGINT) AS x FROM {{orders}}")
sql_operator("win_named", f"SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS n, CAST(sum(o_orderkey) OVER w AS BIGINT) AS s FROM {{orders}} WINDOW w AS ({_W})")
# Spark has no GROUPS frame: it is a RANGE frame over the dense rank
sql_operator(
    "win_frame_groups",
    """SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n
    FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS g FROM {orders})""",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM orders",
)


@operator(
    "win_whole_table",
    "SELECT o_orderkey, row_number() OVER w AS place, CAST(sum(o_custkey) OVER w AS BIGINT) AS running FROM orders WINDOW w AS (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def win_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window without PARTITION BY, by ranges of its order and totals of the ranges before."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    order = ["o_orderstatus", F.desc("o_totalprice"), "o_orderkey"]
    return running(orders, order, {"running": "o_custkey"}, "place").select("o_orderkey", "place", "running")
