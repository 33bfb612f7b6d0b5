"""DML, transactions, constraints, DDL and catalog: each query is the state after the statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.dialect import complete, to_spark
from quern import pragmas
from quern.registry import operator
from quern.shared import shared_path
from quern.sources import catalog
from quern.sources.series import series
from quern.store import ConstraintError, ForeignKey, Store
from quern.tables import load


def _store(spark: SparkSession, sf_dir: str, *names: str, **constraints) -> Store:
    s = Store(spark)
    for n in names:
        s.create(n, load(spark, sf_dir, n), **constraints.get(n, {}))
    return s


def _raises(f) -> bool:
    try:
        f()
    except ConstraintError:
        return True
    return False


def _region(spark: SparkSession, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), "r_regionkey int, r_name string")


_PK = {"region": {"primary": ("r_regionkey",)}}


@operator("dml_insert_values", "SELECT * FROM region UNION ALL SELECT * FROM (VALUES (7, 'NEW'), (8, NULL)) t(a, b)")
def dml_insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region", **_PK)
    s.insert("region", _region(spark, (7, "NEW"), (8, None)))
    return s["region"]


@operator("dml_insert_select", "SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def dml_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region", "nation", **_PK)
    s.insert("region", s["nation"].where("n_regionkey = 1").select((F.col("n_nationkey") + 100).alias("r_regionkey"), F.col("n_name").alias("r_name")))
    return s["region"]


@operator("dml_insert_default", "SELECT * FROM region UNION ALL SELECT 9, 'unnamed'")
def dml_insert_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark)
    s.create("region", load(spark, sf_dir, "region"), defaults={"r_name": "unnamed"})
    s.insert("region", spark.createDataFrame([(9,)], "r_regionkey int"))
    return s["region"]


@operator("dml_insert_or", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'REPLACED' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'NINE'")
def dml_insert_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region", **_PK)
    s.insert("region", _region(spark, (1, "REPLACED")), conflict="replace")
    s.insert("region", _region(spark, (2, "IGNORED"), (9, "NINE")), conflict="ignore")
    return s["region"]


@operator("dml_upsert", "SELECT r_regionkey, CASE WHEN r_regionkey IN (1, 2) THEN r_name || '+' || 'x' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'x'")
def dml_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region", **_PK)
    s.upsert("region", _region(spark, (1, "x"), (2, "x"), (3, "x"), (9, "x")), ["r_regionkey"], {"r_name": "r_name || '+' || excluded.r_name"}, where="r_regionkey < 3")
    return s["region"]


@operator("dml_upsert_nothing", "SELECT * FROM region UNION ALL SELECT 9, 'x'")
def dml_upsert_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region", **_PK)
    s.upsert("region", _region(spark, (1, "x"), (9, "x")), ["r_regionkey"])
    return s["region"]


@operator("dml_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "customer")
    s.update("customer", {"c_acctbal": "0"}, "c_acctbal < 0")
    return s["customer"].select("c_custkey", "c_acctbal")


@operator("dml_update_from", "SELECT n_nationkey, CASE WHEN r_regionkey < 3 THEN r_name ELSE n_name END AS n_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def dml_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "nation")
    source = load(spark, sf_dir, "region").where("r_regionkey < 3").withColumnRenamed("r_regionkey", "n_regionkey")
    s.update("nation", {"n_name": "source.r_name"}, source=source, on=["n_regionkey"])
    return s["nation"].select("n_nationkey", "n_name")


@operator("dml_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 1000)")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "orders")
    s.delete("orders", "o_orderstatus = 'F' AND o_totalprice > 1000")
    return s["orders"].select("o_orderkey")


@operator("dml_returning", "SELECT n_nationkey, n_name || '*' AS n_name FROM nation WHERE n_regionkey = 2")
def dml_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "nation")
    return s.update("nation", {"n_name": "n_name || '*'"}, "n_regionkey = 2").select("n_nationkey", "n_name")


@operator("changes_counters", "SELECT count(*) AS changes, count(*) + 1 AS total FROM nation WHERE n_regionkey = 2")
def changes_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "nation", "region")
    s.insert("region", _region(spark, (9, "x")))
    s.delete("nation", "n_regionkey = 2")
    changes = s.changes
    return spark.range(1).select(F.lit(changes).cast("bigint").alias("changes"), F.lit(s.total_changes).cast("bigint").alias("total"))


@operator("tx_commit", "SELECT * FROM region WHERE r_regionkey > 0")
def tx_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region")
    s.begin()
    s.delete("region", "r_regionkey = 0")
    s.commit()
    return s["region"]


@operator("tx_rollback", "SELECT * FROM region")
def tx_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region")
    s.begin()
    s.delete("region")
    s.rollback()
    return s["region"]


@operator("tx_savepoint", "SELECT * FROM region WHERE r_regionkey NOT IN (0, 3)")
def tx_savepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region")
    s.begin()
    s.delete("region", "r_regionkey = 0")
    s.savepoint("a")
    s.delete("region", "r_regionkey = 1")
    s.rollback("a")
    s.delete("region", "r_regionkey = 3")
    s.release("a")
    s.commit()
    return s["region"]


@operator("trigger", "SELECT 'region' AS tbl, CAST(2 AS BIGINT) AS fired")
def trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region")
    s.create("log", spark.createDataFrame([], "tbl string, n int"))
    s.trigger("t1", "after", "delete", "region", lambda st: st.insert("log", spark.createDataFrame([("region", 1)], "tbl string, n int")))
    s.delete("region", "r_regionkey = 0")
    s.delete("region", "r_regionkey = 1")
    s.drop_trigger("t1")
    s.delete("region", "r_regionkey = 2")
    return s["log"].groupBy("tbl").agg(F.count("*").alias("fired"))


def _family(spark: SparkSession, sf_dir: str, action: str) -> Store:
    s = _store(spark, sf_dir, "region")
    fk = ForeignKey(("n_regionkey",), "region", ("r_regionkey",), action)
    s.create("nation", load(spark, sf_dir, "nation"), foreign=(fk,), defaults={"n_regionkey": 4})
    return s


@operator("fk_cascade", "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 1")
def fk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _family(spark, sf_dir, "cascade")
    s.delete("region", "r_regionkey = 1")
    return s["nation"].select("n_nationkey", "n_regionkey")


@operator("fk_set_null", "SELECT n_nationkey, nullif(n_regionkey, 1) AS n_regionkey FROM nation")
def fk_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _family(spark, sf_dir, "set null")
    s.delete("region", "r_regionkey = 1")
    return s["nation"].select("n_nationkey", "n_regionkey")


@operator("fk_set_default", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 4 ELSE n_regionkey END AS n_regionkey FROM nation")
def fk_set_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _family(spark, sf_dir, "set default")
    s.delete("region", "r_regionkey = 1")
    return s["nation"].select("n_nationkey", "n_regionkey")


@operator("fk_restrict", "SELECT 1 AS refused, 1 AS orphan_refused, count(*) AS n FROM region")
def fk_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _family(spark, sf_dir, "restrict")
    refused = _raises(lambda: s.delete("region", "r_regionkey = 1"))
    orphan = _raises(lambda: s.insert("nation", spark.createDataFrame([(99, "X", 77)], "n_nationkey int, n_name string, n_regionkey int")))
    return s["region"].agg(F.count("*").alias("n")).select(F.lit(int(refused)).alias("refused"), F.lit(int(orphan)).alias("orphan_refused"), "n")


@operator("constraint_check", "SELECT 1 AS refused, count(*) AS n FROM region")
def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region", region={"checks": ("r_regionkey < 100",)})
    refused = _raises(lambda: s.insert("region", _region(spark, (500, "far"))))
    return s["region"].agg(F.count("*").alias("n")).select(F.lit(int(refused)).alias("refused"), "n")


@operator("constraint_notnull", "SELECT 1 AS refused, count(*) + 1 AS n FROM region")
def constraint_notnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region", region={"not_null": ("r_name",)})
    refused = _raises(lambda: s.insert("region", _region(spark, (7, "SEVEN"), (8, None))))
    s.insert("region", _region(spark, (None, "EIGHT")))
    return s["region"].agg(F.count("*").alias("n")).select(F.lit(int(refused)).alias("refused"), "n")


@operator("constraint_unique", "SELECT 1 AS refused, 1 AS again, count(*) + 2 AS n FROM region")
def constraint_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region", region={"unique": (("r_name",),)})
    refused = _raises(lambda: s.insert("region", load(spark, sf_dir, "region").limit(1)))
    again = _raises(lambda: s.insert("region", _region(spark, (8, "NEW"), (9, "NEW"))))  # among the new rows
    s.insert("region", _region(spark, (8, None), (9, None)))  # nulls are no copies
    return s["region"].agg(F.count("*").alias("n")).select(F.lit(int(refused)).alias("refused"), F.lit(int(again)).alias("again"), "n")


@operator("ddl_create_table", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def ddl_create_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "nation")
    s.create("per_region", s["nation"].groupBy("n_regionkey").agg(F.count("*").alias("n")), primary=("n_regionkey",))
    s.create("per_region", s["nation"], if_not_exists=True)
    return s["per_region"]


@operator("ddl_drop_table", "SELECT 'nation' AS name")
def ddl_drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "nation", "region")
    s.drop("region")
    s.drop("region", if_exists=True)
    return spark.createDataFrame([(n,) for n in s.tables], "name string")


@operator("ddl_alter", "SELECT r_regionkey AS id, r_name, 'none' AS note FROM region")
def ddl_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region", **_PK)
    s.add_column("region", "note", "string", "none")
    s.add_column("region", "extra", "int")
    s.rename_column("region", "r_regionkey", "id")
    s.drop_column("region", "extra")
    s.rename("region", "area")
    return s["area"]


@operator("ddl_create_index", "SELECT 'nation' AS tbl, 'by_name' AS name, 'n_name' AS columns, 1 AS is_unique UNION ALL SELECT 'nation', 'by_region', 'n_regionkey,n_name', 0")
def ddl_create_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "nation")
    s.create_index("by_name", "nation", ["n_name"], unique=True)
    s.create_index("by_region", "nation", ["n_regionkey", "n_name"])
    return s.index_list()


@operator("ddl_drop_index", "SELECT count(*) * 2 AS n FROM nation")
def ddl_drop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without its unique index a table takes copies."""
    s = _store(spark, sf_dir, "nation")
    s.create_index("by_name", "nation", ["n_name"], unique=True)
    s.drop_index("by_name")
    s.insert("nation", s["nation"])
    return s["nation"].agg(F.count("*").alias("n"))


@operator("ddl_create_virtual", "SELECT CAST(range AS BIGINT) AS value FROM range(3, 30, 3)")
def ddl_create_virtual(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark)
    s.create("numbers", series(spark, 3, 30, 3))
    return s["numbers"]


@operator("pragma_foreign_key_list", "SELECT 'nation' AS tbl, 'region' AS parent, 'n_regionkey' AS col, 'r_regionkey' AS parent_col, 'cascade' AS on_delete")
def pragma_foreign_key_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "cascade").foreign_key_list()


@operator("pragma_database_list", "SELECT 0 AS seq, 'main' AS name UNION ALL SELECT 1, 'aux'")
def pragma_database_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region")
    s.create("aux.region", load(spark, sf_dir, "region"))
    return s.database_list()


@operator("detach", "SELECT 0 AS seq, 'main' AS name")
def detach(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region")
    s.create("aux.region", load(spark, sf_dir, "region"))
    s.detach("aux")
    return s.database_list()


@operator("hooks", "SELECT 2 AS updates, 1 AS commits, 1 AS rollbacks")
def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, seen = _store(spark, sf_dir, "region"), {"update": 0, "commit": 0, "rollback": 0}
    for event in seen:
        s.hook(event, lambda *_, event=event: seen.__setitem__(event, seen[event] + 1))
    s.begin()
    s.delete("region", "r_regionkey = 0")
    s.commit()
    s.begin()
    s.update("region", {"r_name": "'x'"})
    s.rollback()
    return spark.range(1).select(*[F.lit(seen[k]).alias(n) for k, n in (("update", "updates"), ("commit", "commits"), ("rollback", "rollbacks"))])


@operator(
    "analyze",
    """SELECT 'nation' AS tbl, 'by_region' AS idx, count(*) || ' ' || CAST(ceil(count(*) / count(DISTINCT n_regionkey)) AS BIGINT) || ' 1' AS stat FROM nation
    UNION ALL SELECT 'region', NULL, CAST(count(*) AS VARCHAR) FROM region""",
)
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "nation", "region")
    s.create_index("by_region", "nation", ["n_regionkey", "n_name"])
    return pragmas.analyze(s)


@operator("pragma_table_info", "SELECT * FROM (VALUES (0, 'r_regionkey', 'int', 0, 1), (1, 'r_name', 'string', 0, 0)) t(cid, name, type, \"notnull\", pk)")
def pragma_table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table_info(spark, load(spark, sf_dir, "region"), ["r_regionkey"])


@operator("pragma_foreign_key_check", "SELECT n_nationkey FROM nation WHERE n_regionkey >= 3")
def pragma_foreign_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark)
    s.create("region", load(spark, sf_dir, "region").where("r_regionkey < 3"))
    fk = ForeignKey(("n_regionkey",), "region", ("r_regionkey",))
    return s.orphans(load(spark, sf_dir, "nation"), fk).select("n_nationkey")


@operator("backup", "SELECT * FROM nation")
def backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "nation")
    path = shared_path(spark, "backup")
    s.backup(path)
    return spark.read.schema(s["nation"].schema).parquet(f"{path}/nation")


@operator("attach", "SELECT r_regionkey FROM region")
def attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "region")
    path = shared_path(spark, "attach")
    s.backup(path)
    other = Store(spark)
    other.attach("aux", path, ["region"])
    return other["aux.region"].select("r_regionkey")


@operator("vacuum", "SELECT n_nationkey FROM nation WHERE n_nationkey > 4")
def vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction: the live rows rewritten into as few files as they need."""
    s = _store(spark, sf_dir, "nation")
    s.delete("nation", "n_nationkey <= 4")
    return pragmas.rewritten(s["nation"].select("n_nationkey"), "vacuum")


@operator("explain", "SELECT 1 AS has_scan, 1 AS pushed")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = load(spark, sf_dir, "orders").where("o_orderkey = 5").select("o_custkey")._jdf.queryExecution().executedPlan().toString()
    return spark.range(1).select(F.lit(int("FileScan parquet" in plan)).alias("has_scan"), F.lit(int("EqualTo(o_orderkey,5)" in plan)).alias("pushed"))


@operator("complete", "SELECT 1 AS a, 0 AS b, 1 AS c, 0 AS d, 0 AS e")
def complete_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["SELECT 1;", "SELECT 'x;", "CREATE TRIGGER t AFTER INSERT ON x BEGIN SELECT 1; END;", "SELECT (1;", " ; "]
    return spark.range(1).select(*[F.lit(int(complete(t))).alias(n) for t, n in zip(texts, "abcde", strict=True)])


@operator("dialect", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3 AND o_orderstatus IS NOT NULL ORDER BY o_orderkey LIMIT 5 OFFSET 2")
def dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = to_spark('SELECT "o_orderkey" FROM {orders} WHERE o_orderkey % 10 == 3 AND [o_orderstatus] NOTNULL ORDER BY 1 LIMIT 2, 5')
    return spark.sql(text, orders=load(spark, sf_dir, "orders"))
