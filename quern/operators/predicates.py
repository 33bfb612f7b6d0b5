"""Projection, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import json as J
from quern.functions import numbers as N
from quern.functions import strings as S
from quern.registry import operator, sql_operator
from quern.tables import load

sql_operator("project_cols", "SELECT c_custkey AS id, c_name AS name FROM {customer}")
sql_operator("project_expr", "SELECT o_orderkey, o_custkey * 2 + 1 AS x, upper(o_orderstatus) || '-' || o_orderpriority AS tag FROM {orders}")
sql_operator("project_star", "SELECT * FROM {nation}")
sql_operator("project_table_star", "SELECT n.*, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey")
sql_operator("filter_where", "SELECT p_partkey, p_size FROM {part} WHERE p_size > 20 AND p_retailprice < 1500")
_A = "(SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, nullif(o_custkey % 3, 1) AS a, nullif(o_custkey % 4, 2) AS b FROM {orders}) t"
_I = "CAST({0} AS INT) AS {1}"


def _flags(**tests: str) -> str:
    return ", ".join(f"CAST({test} AS INT) AS {name}" for name, test in tests.items())


sql_operator("pred_compare", f"SELECT o_orderkey, {_flags(eq='a = b', ne='a <> b', lt='a < b', le='a <= b', gt='a > b', ge='a >= b')} FROM {_A}")
sql_operator("pred_is", f"SELECT o_orderkey, CAST(a <=> b AS INT) AS same FROM {_A}", f"SELECT o_orderkey, CAST(a IS NOT DISTINCT FROM b AS INT) AS same FROM {_A}".replace("{orders}", "orders"))
sql_operator("pred_is_not", f"SELECT o_orderkey FROM {_A} WHERE NOT (a <=> b)", f"SELECT o_orderkey FROM {_A} WHERE a IS DISTINCT FROM b".replace("{orders}", "orders"))
sql_operator("pred_is_distinct", f"SELECT o_orderkey, {_flags(d='a IS DISTINCT FROM b', n='a IS NOT DISTINCT FROM b')} FROM {_A}")
sql_operator("pred_isnull", f"SELECT o_orderkey, {_flags(x='a IS NULL', y='b IS NOT NULL')} FROM {_A} WHERE a IS NULL OR b IS NULL")
sql_operator("pred_and_or_not", f"SELECT o_orderkey, {_flags(c='a = 0 AND b = 0', d='a = 0 OR b = 0', n='NOT (a = 0)')} FROM {_A}")
sql_operator("pred_between", f"SELECT o_orderkey, {_flags(i='a BETWEEN 0 AND b', o='a NOT BETWEEN b AND 2')} FROM {_A}")
sql_operator("pred_in_list", f"SELECT o_orderkey, {_flags(i='a IN (0, 5)', o='a NOT IN (0, 5)', u='a IN (5, NULL)')} FROM {_A}")
sql_operator("pred_in_subquery", "SELECT c_custkey FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)")
sql_operator("pred_not_in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 100000)")
sql_operator("pred_in_table", "SELECT n_nationkey FROM {nation} WHERE n_regionkey IN (SELECT r_regionkey FROM {region})")
sql_operator("pred_exists", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_totalprice > 300000)")
sql_operator("pred_not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")


@operator("pred_like", "SELECT p_partkey, CAST(p_type ILIKE '%ST_el' AS INT) AS a, CAST(p_name NOT ILIKE 'P%' AS INT) AS b, CAST(p_brand ILIKE 'brand$#_1' ESCAPE '$' AS INT) AS c FROM part")
def pred_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        "p_partkey", S.like(F.col("p_type"), "%ST_el").cast("int").alias("a"), (~S.like(F.col("p_name"), "P%")).cast("int").alias("b"), S.like(F.col("p_brand"), "brand$#_1", "$").cast("int").alias("c")
    )


@operator("pred_glob", "SELECT c_custkey, CAST(c_name GLOB 'C*[0-4]' AS INT) AS a, CAST(c_mktsegment GLOB '?U*' AS INT) AS b, CAST(NOT (c_name GLOB '*[^0-8]') AS INT) AS c FROM customer".replace("[^0-8]", "[!0-8]"))
def pred_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        "c_custkey", S.glob(F.col("c_name"), "C*[0-4]").cast("int").alias("a"), S.glob(F.col("c_mktsegment"), "?U*").cast("int").alias("b"), (~S.glob(F.col("c_name"), "*[^0-8]")).cast("int").alias("c")
    )


sql_operator("pred_regexp", "SELECT p_partkey FROM {part} WHERE regexp_like(p_name, '[0-9]*7$')", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '[0-9]*7$')")


@operator("pred_match", "SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: starts_with(t, 'thre'))) > 0")
def pred_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.sources import fulltext

    return load(spark, sf_dir, "documents").where(fulltext.match(F.col("text"), "thre")).select("doc_id")


sql_operator("collate_nocase", "SELECT n_nationkey FROM {nation} WHERE n_name COLLATE UTF8_LCASE = 'NaTiOn_3'", "SELECT n_nationkey FROM nation WHERE n_name COLLATE NOCASE = 'NaTiOn_3'")
sql_operator("collate_rtrim", "SELECT n_nationkey FROM {nation} WHERE rtrim(n_name || '  ') = n_name")
sql_operator("expr_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS a, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' END AS b FROM {orders}")
sql_operator(
    "expr_cast",
    "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(o_orderkey AS DOUBLE) AS d, try_cast(o_orderpriority AS BIGINT) AS n, CAST(floor(o_totalprice) AS BIGINT) AS i FROM {orders}",
    "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderkey AS DOUBLE) AS d, try_cast(o_orderpriority AS BIGINT) AS n, CAST(floor(o_totalprice) AS BIGINT) AS i FROM orders",
)


@operator("expr_cast_prefix", r"SELECT o_orderkey, coalesce(try_cast(regexp_extract(o_orderpriority, '^\s*([+-]?\d+)', 1) AS BIGINT), 0) AS p FROM orders")
def expr_cast_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", N.integer_prefix(F.col("o_orderpriority")).alias("p"))


sql_operator(
    "expr_arith",
    "SELECT o_orderkey, o_custkey + 7 AS a, o_custkey - o_orderkey AS b, o_custkey * 3 AS c, o_orderkey DIV nullif(o_custkey % 5, 0) AS d, o_orderkey % nullif(o_custkey % 5, 0) AS e, -o_custkey AS f, try_divide(o_totalprice, o_custkey % 2) AS g FROM {orders}",
    "SELECT o_orderkey, o_custkey + 7 AS a, o_custkey - o_orderkey AS b, o_custkey * 3 AS c, o_orderkey // nullif(o_custkey % 5, 0) AS d, o_orderkey % nullif(o_custkey % 5, 0) AS e, -o_custkey AS f, o_totalprice / nullif(o_custkey % 2, 0) AS g FROM orders",
)
sql_operator(
    "expr_bitwise",
    "SELECT o_orderkey, o_orderkey & 6 AS a, o_orderkey | 9 AS b, ~o_orderkey AS c, shiftleft(o_orderkey, 2) AS d, shiftright(o_orderkey, 1) AS e FROM {orders}",
    "SELECT o_orderkey, o_orderkey & 6 AS a, o_orderkey | 9 AS b, ~o_orderkey AS c, o_orderkey * 4 AS d, o_orderkey >> 1 AS e FROM orders",
)
sql_operator("expr_concat", "SELECT c_custkey, c_name || '/' || c_mktsegment AS s, c_name || nullif(c_mktsegment, 'BUILDING') AS n FROM {customer}")


@operator("expr_json_arrow", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS a, json_extract_string(props, '$.k') AS b FROM events")
def expr_json_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", J.arrow(F.col("props"), "$.k").alias("a"), J.arrow2(F.col("props"), "$.k").alias("b"))


@operator("bind_params", "SELECT o_orderkey FROM orders WHERE o_custkey > 100 AND o_orderstatus = 'O' AND o_totalprice < 50000")
def bind_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_custkey > :low AND o_orderstatus = :status AND o_totalprice < :price", args={"low": 100, "status": "O", "price": 50000}, orders=load(spark, sf_dir, "orders"))


sql_operator("literals", "SELECT 42 AS i, 2.5D AS d, 'it''s' AS s, hex(X'0aff') AS b, CAST(NULL AS INT) AS n", "SELECT 42 AS i, CAST(2.5 AS DOUBLE) AS d, 'it''s' AS s, hex(from_hex('0aff')) AS b, CAST(NULL AS INT) AS n")
