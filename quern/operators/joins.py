"""Joins: Catalyst and adaptive execution pick the physical join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.engine import Database
from quern.registry import operator, sql_operator
from quern.tables import load

# outer joins: a condition on the price leaves rows of both sides unmatched and drops none
_MATCH = "c.c_custkey = o.o_custkey AND o.o_totalprice > 400000"
sql_operator("join_inner_on", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 150000")
sql_operator("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
sql_operator("join_comma", "SELECT n.n_name, r.r_name FROM {nation} n, {region} r WHERE n.n_regionkey = r.r_regionkey")
sql_operator("join_cross", "SELECT n.n_nationkey, r.r_regionkey FROM {nation} n CROSS JOIN {region} r")
sql_operator("join_using", "SELECT k, c_name, n FROM (SELECT c_custkey AS k, c_name FROM {customer}) JOIN (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) USING (k)", "SELECT k, c_name, n FROM (SELECT c_custkey AS k, c_name FROM customer) a JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) b USING (k)")
sql_operator("join_natural", "SELECT * FROM (SELECT n_nationkey, n_regionkey AS k FROM {nation}) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM {region}) b")
sql_operator("join_natural_left", "SELECT * FROM (SELECT n_nationkey, n_regionkey AS k FROM {nation}) a NATURAL LEFT JOIN (SELECT r_regionkey AS k, r_name FROM {region} WHERE r_regionkey < 2) b")
sql_operator("join_left", f"SELECT c.c_custkey, o.o_orderkey FROM {{customer}} c LEFT JOIN {{orders}} o ON {_MATCH}")
sql_operator("join_right", f"SELECT o.o_orderkey, c.c_custkey FROM {{orders}} o RIGHT JOIN {{customer}} c ON {_MATCH}")
sql_operator("join_full", f"SELECT o.o_orderkey, c.c_custkey FROM {{orders}} o FULL JOIN {{customer}} c ON {_MATCH}")
sql_operator("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
sql_operator(
    "join_multiway",
    """SELECT r.r_name, count(*) AS n, round(sum(l.l_extendedprice), 2) AS price FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
    JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""",
)
sql_operator("join_semi", "SELECT c.c_custkey FROM {customer} c LEFT SEMI JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql_operator("join_anti", "SELECT c.c_custkey FROM {customer} c LEFT ANTI JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")


@operator("join_update_from", "SELECT n.n_nationkey, coalesce(r.r_name, n.n_name) AS n_name FROM nation n LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 1) r ON n.n_regionkey = r.r_regionkey")
def join_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    for t in ("nation", "region"):
        db.store.create(t, load(spark, sf_dir, t))
    db.execute("UPDATE nation SET n_name = r.r_name FROM region AS r WHERE nation.n_regionkey = r.r_regionkey AND r.r_regionkey > 1")
    return db.query("SELECT n_nationkey, n_name FROM nation")
