"""Scans and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.registry import operator, sql_operator
from quern.sources import blobs, boxes, catalog, changes, fulltext, series
from quern.tables import TABLES, load

sql_operator("scan_full", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM {orders}")
sql_operator("scan_reverse", "SELECT o_orderkey, o_orderdate FROM {orders} ORDER BY o_orderkey DESC")
sql_operator("scan_rowid_seek", "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderkey = 4711")
sql_operator("scan_index_eq", "SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment = 'BUILDING'")
sql_operator("scan_index_range", "SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderkey BETWEEN 100 AND 900 AND o_orderdate >= TIMESTAMP '1996-01-01'")
sql_operator("scan_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(n, s)")
sql_operator("scan_no_from", "SELECT 1 + 2 * 3 AS n, 'x' || 'y' AS s")
sql_operator("scan_cte", "WITH big AS (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 200000) SELECT count(*) AS n, round(max(o_totalprice), 2) AS top FROM big")
sql_operator("scan_subquery_from", "SELECT s.c_nationkey, s.n FROM (SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey) s WHERE s.n > 50")
sql_operator("scan_tvf", "SELECT id * id AS sq FROM range(1, 101)", "SELECT range * range AS sq FROM range(1, 101)")


@operator("scan_view", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def scan_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "nation").where("n_regionkey = 1").createOrReplaceTempView("quern_scan_view")
    return spark.table("quern_scan_view").select("n_nationkey", "n_name")


_COLUMNS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@operator("scan_catalog", "SELECT * FROM (VALUES " + ", ".join(f"('table', '{t}', '{t}', CAST({n} AS BIGINT))" for t, n in _COLUMNS.items()) + ") AS t(type, name, tbl_name, n_columns)")
def scan_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.master(spark, {t: load(spark, sf_dir, t) for t in TABLES})


@operator("scan_vtab", "SELECT CAST(range AS BIGINT) AS value FROM range(10, 500, 7)")
def scan_vtab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series(spark, 10, 500, 7)


@operator("vtab_register", "SELECT CAST(sum(range) AS BIGINT) AS total, count(*) AS n FROM range(0, 1000)")
def vtab_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series(spark, 0, 1000, 1).agg(F.sum("value").alias("total"), F.count("*").alias("n"))


# word = prefix of a token without the marks at its ends, phrase = part of the text, all must match
@operator(
    "vtab_fts",
    r"""SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: starts_with(regexp_replace(t, '^[^\p{L}\p{N}]+', ''), 'then'))) > 0
    AND len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: starts_with(regexp_replace(t, '^[^\p{L}\p{N}]+', ''), 'onre'))) > 0 AND contains(lower(text), 'of the')""",
)
def vtab_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where(fulltext.match(F.col("text"), 'then AND onre "of the"')).select("doc_id")


_BOX = "CAST(p_size AS DOUBLE) AS x0, p_size + p_retailprice / 100 AS x1, CAST(p_partkey % 50 AS DOUBLE) AS y0, p_partkey % 50 + 5.0 AS y1"


@operator("vtab_rtree", f"WITH b AS (SELECT p_partkey AS id, {_BOX.replace('5.0', 'CAST(5 AS DOUBLE)')} FROM part) SELECT id FROM b WHERE x1 >= 10 AND x0 <= 20 AND y1 >= 7 AND y0 <= 9")
def vtab_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    box = part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + F.col("p_retailprice") / 100).alias("x1"), (F.col("p_partkey") % 50).cast("double").alias("y0"), (F.col("p_partkey") % 50 + F.lit(5.0)).alias("y1"))
    return box.where(boxes.overlaps({"x": (10.0, 20.0), "y": (7.0, 9.0)})).select("id")


@operator(
    "vtab_rtree_join",
    """WITH b AS (SELECT s_suppkey AS id, CAST(s_suppkey % 40 AS DOUBLE) AS x0, s_suppkey % 40 + CAST(3 AS DOUBLE) AS x1, CAST(s_nationkey AS DOUBLE) AS y0, s_nationkey + CAST(2 AS DOUBLE) AS y1 FROM supplier)
    SELECT a.id AS a_id, c.id AS b_id FROM b a JOIN b c ON a.id < c.id AND a.x0 <= c.x1 AND a.x1 >= c.x0 AND a.y0 <= c.y1 AND a.y1 >= c.y0""",
)
def vtab_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    box = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 40).cast("double").alias("x0"), (F.col("s_suppkey") % 40 + F.lit(3.0)).alias("x1"), F.col("s_nationkey").cast("double").alias("y0"), (F.col("s_nationkey") + F.lit(2.0)).alias("y1"))
    return boxes.overlap_join(box, cell={"x": 4.0, "y": 4.0})


@operator(
    "vtab_dbstat",
    "SELECT 'nation' AS name, count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns, CAST(sum(strlen(n_name)) AS BIGINT) AS payload FROM nation UNION ALL SELECT 'orders', count(*), CAST(6 AS BIGINT), CAST(sum(strlen(o_orderstatus) + strlen(o_orderpriority)) AS BIGINT) FROM orders",
)
def vtab_dbstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.statistics(spark, {t: load(spark, sf_dir, t) for t in ("nation", "orders")})


@operator("blob_io", "SELECT c_custkey, hex(encode(substr(c_name, 3, 4))) AS piece FROM customer")
def blob_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").withColumn("data", F.encode("c_name", "utf-8"))
    return c.select("c_custkey", F.hex(blobs.read(F.col("data"), 2, 4)).alias("piece"))


@operator("blob_write", "SELECT c_custkey, substr(c_name, 1, 2) || 'ZZ' || substr(c_name, 5) AS name FROM customer")
def blob_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").withColumn("data", F.encode("c_name", "utf-8"))
    return c.select("c_custkey", F.decode(blobs.write(F.col("data"), 2, F.encode(F.lit("ZZ"), "utf-8")), "utf-8").alias("name"))


@operator(
    "session_cdc",
    """WITH old AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 20), new AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN n_name || '!' ELSE n_name END AS v FROM nation WHERE n_nationkey >= 3)
    SELECT CASE WHEN old.k IS NULL THEN 'I' WHEN new.k IS NULL THEN 'D' ELSE 'U' END AS op, coalesce(old.k, new.k) AS pk, old.v AS old_v, new.v AS new_v
    FROM old FULL OUTER JOIN new ON old.k = new.k WHERE old.v IS DISTINCT FROM new.v""",
)
def session_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    new = nation.where("k >= 3").withColumn("v", F.when(F.col("k") % 5 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    diff = changes.diff(nation.where("k < 20"), new, ["k"])
    return diff.select("op", F.col("k").alias("pk"), F.col("old.v").alias("old_v"), F.col("new.v").alias("new_v"))


_CHANGES = """WITH old AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 20), new AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS v FROM nation WHERE n_nationkey >= 3)
    SELECT CASE WHEN old.k IS NULL THEN 'I' WHEN new.k IS NULL THEN 'D' ELSE 'U' END AS op, coalesce(old.k, new.k) AS pk, old.v AS old_v, new.v AS new_v
    FROM old FULL OUTER JOIN new ON old.k = new.k WHERE old.k IS NULL OR new.k IS NULL OR old.v IS DISTINCT FROM new.v"""


@operator("session_changeset", _CHANGES)
def session_changeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changeset written as bytes and read back."""
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    new = nation.where("k >= 3").withColumn("v", F.when(F.col("k") % 5 != 0, F.col("v")))
    diff = changes.diff(nation.where("k < 20"), new, ["k"])
    back = changes.decode(changes.encode(diff), diff.schema)
    return back.select("op", F.col("k").alias("pk"), F.col("old.v").alias("old_v"), F.col("new.v").alias("new_v"))


@operator("session_apply", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN n_name || '!' ELSE n_name END AS v FROM nation WHERE n_nationkey >= 3")
def session_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    new = nation.where("k >= 3").withColumn("v", F.when(F.col("k") % 5 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    old = nation.where("k < 20")
    return changes.apply(old, changes.diff(old, new, ["k"]), ["k"])


@operator("session_invert", "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 20")
def session_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    new = nation.where("k >= 3").withColumn("v", F.when(F.col("k") % 5 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    old = nation.where("k < 20")
    return changes.apply(new, changes.invert(changes.diff(old, new, ["k"])), ["k"])
