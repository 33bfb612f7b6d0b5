"""SQL text into the store, user functions, hooks and the remaining PRAGMAs: each query is the state after the statements."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import store as stores
from quern.engine import Database
from quern.functions.registry import Functions
from quern.registry import operator
from quern.store import ConstraintError, NotAuthorizedError
from quern.tables import load


def _database(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    db = Database(spark)
    for n in names:
        db.store.create(n, load(spark, sf_dir, n))
    return db


def _refused(db: Database, text: str) -> int:
    try:
        db.execute(text)
    except ConstraintError:
        return 1
    return 0


@operator(
    "sql_text",
    """SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE upper(n_name) END AS name, n_regionkey * 10 AS tenfold FROM nation WHERE n_regionkey <> 3
    UNION ALL SELECT 100, 'NEW', 0""",
)
def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DDL, DML, a transaction and a query as one text."""
    db = _database(spark, sf_dir, "nation")
    return db.query(
        """CREATE TABLE places (id INTEGER PRIMARY KEY, name TEXT NOT NULL, region INT DEFAULT 0 CHECK (region < 100), tenfold INT AS (region * 10));
        INSERT INTO places (id, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation; -- a comment; with a semicolon
        BEGIN; UPDATE places SET name = upper(name) || CASE region WHEN 1 THEN '!' ELSE '' END; SAVEPOINT s; DELETE FROM places; ROLLBACK TO s;
        DELETE FROM places WHERE region == ?; INSERT INTO places (id, name) VALUES (100, 'NEW'); COMMIT;
        SELECT CAST(id AS INT) AS id, name, CAST(tenfold AS INT) AS tenfold FROM places""".replace("?", "3")
    )


@operator("sql_upsert", "SELECT r_regionkey, CASE WHEN r_regionkey IN (1, 2) THEN r_name || '+x' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'x'")
def sql_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.store.create("region", load(spark, sf_dir, "region"), primary=("r_regionkey",))
    db.execute("INSERT INTO region VALUES (1, 'x'), (2, 'x'), (3, 'x'), (9, 'x') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = region.r_name || '+' || excluded.r_name WHERE r_regionkey < 3")
    return db.store["region"]


@operator("dml_insert_fail", "SELECT 1 AS refused, r_regionkey, r_name FROM region UNION ALL SELECT 1, 7, 'SEVEN'")
def dml_insert_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FAIL: rows before the first that breaks a constraint stay."""
    db = Database(spark)
    db.store.create("region", load(spark, sf_dir, "region"), primary=("r_regionkey",))
    refused = _refused(db, "INSERT OR FAIL INTO region VALUES (7, 'SEVEN'), (1, 'AGAIN'), (8, 'EIGHT')")
    return db.store["region"].select(F.lit(refused).alias("refused"), "r_regionkey", "r_name")


@operator("dml_insert_rollback", "SELECT 1 AS refused, 0 AS open, count(*) AS n FROM region")
def dml_insert_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROLLBACK: the whole transaction goes."""
    db = Database(spark)
    db.store.create("region", load(spark, sf_dir, "region"), unique=(("r_name",),))
    db.execute("BEGIN; INSERT INTO region VALUES (7, 'SEVEN')")
    refused = _refused(db, "INSERT OR ROLLBACK INTO region VALUES (8, 'EIGHT'), (9, 'SEVEN')")
    return db.store["region"].agg(F.count("*").alias("n")).select(F.lit(refused).alias("refused"), F.lit(len(db.store.stack)).alias("open"), "n")


@operator("dml_update_or", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'FREE' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 5")
def dml_update_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPDATE OR IGNORE leaves a row whose new key another has; OR REPLACE removes the other."""
    db = Database(spark)
    db.store.create("nation", load(spark, sf_dir, "nation"), primary=("n_nationkey",))
    db.execute("UPDATE OR IGNORE nation SET n_nationkey = 6 WHERE n_nationkey = 4; UPDATE OR REPLACE nation SET n_name = 'FREE', n_nationkey = 5 WHERE n_nationkey = 3; UPDATE nation SET n_nationkey = 3 WHERE n_nationkey = 5")
    return db.store["nation"].select("n_nationkey", "n_name")


_PARENT = "CREATE TABLE parent (k INT PRIMARY KEY, name TEXT); INSERT INTO parent SELECT r_regionkey, r_name FROM region;"


def _children(spark: SparkSession, sf_dir: str, reference: str) -> Database:
    db = _database(spark, sf_dir, "region", "nation")
    db.execute(f"{_PARENT} CREATE TABLE child (id INT PRIMARY KEY, k INT DEFAULT 4 REFERENCES parent (k) {reference}); INSERT INTO child SELECT n_nationkey, n_regionkey FROM nation")
    return db


def _child(db: Database) -> DataFrame:
    return db.query("SELECT CAST(id AS INT) AS id, CAST(k AS INT) AS k FROM child")


@operator("fk_update_cascade", "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN 11 ELSE n_regionkey END AS k FROM nation")
def fk_update_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _children(spark, sf_dir, "ON UPDATE CASCADE")
    db.execute("UPDATE parent SET k = 11 WHERE k = 1")
    return _child(db)


@operator("fk_update_set_null", "SELECT n_nationkey AS id, nullif(n_regionkey, 1) AS k FROM nation")
def fk_update_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _children(spark, sf_dir, "ON UPDATE SET NULL")
    db.execute("UPDATE parent SET k = 11 WHERE k = 1; UPDATE parent SET name = 'no key changes'")
    return _child(db)


@operator("fk_update_set_default", "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN 4 ELSE n_regionkey END AS k FROM nation")
def fk_update_set_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _children(spark, sf_dir, "ON UPDATE SET DEFAULT")
    db.execute("UPDATE parent SET k = 11 WHERE k = 1")
    return _child(db)


@operator("fk_update_restrict", "SELECT 1 AS refused, r_regionkey AS k FROM region")
def fk_update_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _children(spark, sf_dir, "ON UPDATE RESTRICT")
    refused = _refused(db, "UPDATE parent SET k = k + 10")
    return db.query("SELECT CAST(k AS INT) AS k FROM parent").select(F.lit(refused).alias("refused"), "k")


@operator("fk_deferred", "SELECT 1 AS refused_at_commit, n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN 22 ELSE n_regionkey END AS k FROM nation")
def fk_deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A broken key is told by COMMIT, and the transaction goes on until it is mended."""
    db = _children(spark, sf_dir, "DEFERRABLE INITIALLY DEFERRED")
    db.execute("BEGIN; UPDATE parent SET k = 22 WHERE k = 2")
    refused = _refused(db, "COMMIT")
    db.execute("UPDATE child SET k = 22 WHERE k = 2; COMMIT")
    return _child(db).select(F.lit(refused).alias("refused_at_commit"), "id", "k")


@operator("trigger_when", "SELECT n_nationkey AS id, n_name || '>' || lower(n_name) AS what FROM nation WHERE n_regionkey = 2")
def trigger_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPDATE OF a column, with a condition, row by row, as sets."""
    db = _database(spark, sf_dir, "nation")
    return db.query(
        """CREATE TABLE log (id INT, what TEXT);
        CREATE TRIGGER t AFTER UPDATE OF n_name ON nation FOR EACH ROW WHEN OLD.n_regionkey = 2 BEGIN INSERT INTO log VALUES (NEW.n_nationkey, OLD.n_name || '>' || NEW.n_name); END;
        UPDATE nation SET n_name = lower(n_name); UPDATE nation SET n_regionkey = 2;
        SELECT CAST(id AS INT) AS id, what FROM log"""
    )


@operator("trigger_instead_of", "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'two' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 3 UNION ALL SELECT 9, 'NINE'")
def trigger_instead_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a view by its triggers."""
    db = _database(spark, sf_dir, "region")
    db.execute(
        """CREATE VIEW v (k, name) AS SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 0;
        CREATE TRIGGER i INSTEAD OF INSERT ON v BEGIN INSERT INTO region VALUES (NEW.k, upper(NEW.name)); END;
        CREATE TRIGGER u INSTEAD OF UPDATE ON v BEGIN UPDATE region SET r_name = NEW.name WHERE r_regionkey = OLD.k; END;
        CREATE TRIGGER d INSTEAD OF DELETE ON v BEGIN DELETE FROM region WHERE r_regionkey = OLD.k; END;
        INSERT INTO v VALUES (9, 'nine'); UPDATE v SET name = 'two' WHERE k = 2; DELETE FROM v WHERE k = 3"""
    )
    return db.store["region"]


@operator("trigger_raise", "SELECT 1 AS refused, count(*) - (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS n FROM nation")
def trigger_raise(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, "nation")
    db.execute("CREATE TRIGGER t BEFORE DELETE ON nation BEGIN SELECT RAISE(ABORT, 'stays') WHERE OLD.n_regionkey = 2; END; DELETE FROM nation WHERE n_regionkey = 1")
    refused = _refused(db, "DELETE FROM nation")
    return db.store["nation"].agg(F.count("*").alias("n")).select(F.lit(refused).alias("refused"), "n")


@operator("fn_overload", "SELECT n_nationkey, n_nationkey * 2 AS one, n_nationkey + n_regionkey AS two, n_nationkey + n_regionkey + 1 AS three FROM nation")
def fn_overload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name for several numbers of arguments: an exact fit goes before one that takes any number."""
    f = Functions(spark)
    f.scalar("combine", lambda a: a * 2, "int", 1)
    f.scalar("combine", lambda a, b: a + b, "int", 2)
    f.scalar("combine", lambda *v: sum(v), "int")
    text = f.resolve("SELECT n_nationkey, combine(n_nationkey) AS one, combine(n_nationkey, n_regionkey) AS two, combine(n_nationkey, n_regionkey, 1) AS three FROM n")
    return spark.sql(f"WITH n AS (SELECT * FROM {{nation}}) {text}", nation=load(spark, sf_dir, "nation"))


class _Digits:
    def eval(self, k: int):
        for place, digit in enumerate(reversed(str(k))):
            yield place, int(digit)


@operator("scan_udtf", "SELECT c_custkey, CAST(p AS INTEGER) AS place, CAST(substr(reverse(CAST(c_custkey AS VARCHAR)), CAST(p AS INTEGER) + 1, 1) AS INTEGER) AS digit FROM customer, range(0, 20) r(p) WHERE p < length(CAST(c_custkey AS VARCHAR))")
def scan_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered table function, called for each row by LATERAL."""
    Functions(spark).table("digits_of", _Digits, "place int, digit int")
    return spark.sql("SELECT c_custkey, d.place, d.digit FROM {customer}, LATERAL digits_of(CAST(c_custkey AS INT)) d", customer=load(spark, sf_dir, "customer"))


@operator("extension", "SELECT n_nationkey, length(n_name) AS size FROM nation")
def extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension brings a function and a table."""

    def init(store: stores.Store) -> None:
        Functions(store.spark).scalar("size_of", lambda s: s.str.len().astype("int32") if len(s) else pd.Series([], dtype="int32"), "int", 1)
        store.create("extended", load(store.spark, sf_dir, "nation"))

    stores.register_extension("sizes", init)
    db = Database(spark)
    stores.load_extension(db.store, "sizes")
    return db.query("SELECT n_nationkey, size_of__1(n_name) AS size FROM extended")


@operator("authorizer", "SELECT 1 AS denied, n_nationkey, n_name FROM nation")
def authorizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes are denied, updates of a column ignored."""
    db = _database(spark, sf_dir, "nation")
    db.store.authorizer = lambda action, *names: "deny" if action == "delete" else "ignore" if action == "update" and "n_name" in names else "ok"
    denied = 0
    try:
        db.execute("DELETE FROM nation")
    except NotAuthorizedError:
        denied = 1
    db.execute("UPDATE nation SET n_name = 'x'")
    return db.store["nation"].select(F.lit(denied).alias("denied"), "n_nationkey", "n_name")


@operator("trace", "SELECT * FROM (VALUES (0, 'DELETE FROM region WHERE r_regionkey = 0'), (1, 'SELECT count(*) FROM region')) t(n, text)")
def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, seen = _database(spark, sf_dir, "region"), []
    db.store.hook("trace", seen.append)
    db.execute("DELETE FROM region WHERE r_regionkey = 0; SELECT count(*) FROM region;")
    return spark.createDataFrame(list(enumerate(seen)), "n int, text string")


def _people(spark: SparkSession, sf_dir: str) -> Database:
    db = _database(spark, sf_dir, "customer")
    db.execute(
        """CREATE TABLE people (id INTEGER PRIMARY KEY, name TEXT NOT NULL UNIQUE, nation INT DEFAULT 7, twice INT AS (nation * 2));
        CREATE INDEX by_nation ON people (nation, name); INSERT INTO people (id, name, nation) SELECT c_custkey, c_name, c_nationkey FROM customer"""
    )
    return db


@operator("pragma_table_xinfo", """SELECT * FROM (VALUES (0, 'id', 'bigint', 0, NULL, 1, 0), (1, 'name', 'string', 1, NULL, 0, 0), (2, 'nation', 'bigint', 0, '7', 0, 0), (3, 'twice', 'bigint', 0, NULL, 0, 3)) t(cid, name, type, "notnull", dflt_value, pk, hidden)""")
def pragma_table_xinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).query("PRAGMA table_xinfo(people)")


@operator("pragma_index_list", """SELECT * FROM (VALUES (0, 'by_nation', 0, 'c', 0), (1, 'autoindex_people_1', 1, 'pk', 0), (2, 'autoindex_people_2', 1, 'u', 0)) t(seq, name, "unique", origin, partial)""")
def pragma_index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).query("PRAGMA index_list(people)")


@operator("pragma_index_info", "SELECT * FROM (VALUES (0, 2, 'nation'), (1, 1, 'name')) t(seqno, cid, name)")
def pragma_index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).query("PRAGMA index_info(by_nation)")


@operator("pragma_stats", "SELECT 'people' AS tbl, CAST(NULL AS VARCHAR) AS idx, count(*) AS hght FROM customer UNION ALL SELECT 'people', 'by_nation', count(*) FROM customer UNION ALL SELECT 'customer', NULL, count(*) FROM customer")
def pragma_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).query("PRAGMA stats").select("tbl", "idx", "hght")


@operator("pragma_user_version", "SELECT CAST(12 AS BIGINT) AS user_version")
def pragma_user_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Database(spark).query("PRAGMA user_version = 12; PRAGMA user_version")


@operator("pragma_foreign_keys", "SELECT 0 AS foreign_keys, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS orphans")
def pragma_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With foreign keys off a parent can go; the check finds the orphans."""
    db = _children(spark, sf_dir, "ON DELETE RESTRICT")
    off = db.query("PRAGMA foreign_keys = OFF")
    db.execute("DELETE FROM parent WHERE k = 1")
    return off.crossJoin(db.query("PRAGMA foreign_key_check").select(F.col("n").alias("orphans")))


@operator("pragma_integrity_check", "SELECT CASE WHEN count(*) > count(DISTINCT c_nationkey) THEN 'UNIQUE constraint failed: customer.c_nationkey' ELSE 'ok' END AS integrity_check FROM customer")
def pragma_integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came in past the constraints are found."""
    db = Database(spark)
    customers = load(spark, sf_dir, "customer")
    db.store.create("customer", customers.where("false"), unique=(("c_nationkey",),))
    db.store.tables["customer"] = stores.replace(db.store.tables["customer"], df=customers)
    return db.query("PRAGMA integrity_check")


@operator("pragma_compile_options", "SELECT 'spark.sql.ansi.enabled=true' AS compile_options")
def pragma_compile_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Database(spark).query("PRAGMA compile_options").where("compile_options LIKE '%ansi%'")


@operator("reindex", "SELECT 1 AS refused, count(*) AS n FROM region")
def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique indexes are looked at again over the whole table."""
    db = _database(spark, sf_dir, "region")
    db.execute("CREATE UNIQUE INDEX i ON region (r_name); REINDEX; REINDEX i")
    t = db.store.tables["region"]
    db.store.tables["region"] = stores.replace(t, df=t.df.unionAll(t.df))
    refused = _refused(db, "REINDEX region")
    return t.df.agg(F.count("*").alias("n")).select(F.lit(refused).alias("refused"), "n")
