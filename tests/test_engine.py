"""SQL text into the store: statements, constraints, triggers, transactions, PRAGMAs, functions, hooks."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quern import store as stores
from quern.dialect import complete, split, to_spark
from quern.engine import Database, SqlError
from quern.functions import json as J
from quern.functions.registry import Aggregate, Functions
from quern.shared import shared_dir, shared_path, shared_table
from quern.store import ConstraintError, NotAuthorizedError, Store


@pytest.fixture
def db(spark):
    return Database(spark)


def rows(db, text, *params):
    return sorted((tuple(r) for r in db.query(text, *params).collect()), key=repr)


def test_create_insert_select(db):
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, name TEXT NOT NULL DEFAULT 'x', v REAL CHECK (v > 0), w INT GENERATED ALWAYS AS (id * 2))")
    db.execute("INSERT INTO t(name, v) VALUES ('a', 1.5), ('b', ?), ('it''s {x}', :p)".replace(":p", "?"), 2.5, 3)
    assert rows(db, "SELECT * FROM t") == [(1, "a", 1.5, 2), (2, "b", 2.5, 4), (3, "it's {x}", 3.0, 6)]
    assert rows(db, "INSERT INTO t(id, v) VALUES ($k, @v) RETURNING id, name", {"k": 9, "v": 1.0}) == [(9, "x")]
    assert rows(db, "SELECT count(*) FROM main.t WHERE name GLOB '*' || 's {x}' AND id IS NOT 9 AND id IS 3") == [(1,)]
    for bad in ("INSERT INTO t VALUES (1, 'dup', 1)", "INSERT INTO t(name, v) VALUES ('n', -1)", "INSERT INTO t(name, v) VALUES (NULL, 1)"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    for bad in ("FOO", "INSERT INTO t(id) VALUES (1, 2)", "SELECT ?", "SELECT 1 FROM t WHERE id = :a", "DROP VIEW t", "CREATE TABLE T(a)", "PRAGMA nothing", "UPDATE t SET q = 1", "UPDATE t SET w = 1", "INSERT INTO nope VALUES (1)", "SELECT 1; EXPLAIN DELETE FROM t"):
        with pytest.raises(ValueError):
            db.execute(bad)
    assert rows(db, "SELECT count(*) FROM t") == [(4,)]


@pytest.mark.parametrize("clause,left,raises", [("ABORT", [1, 2], True), ("FAIL", [1, 2, 8], True), ("IGNORE", [1, 2, 8, 9], False), ("REPLACE", [1, 8, 9, 22], False), ("ROLLBACK", [1], True)])
def test_conflict_clauses(db, clause, left, raises):
    db.execute("CREATE TABLE t(id INT PRIMARY KEY, u TEXT UNIQUE); INSERT INTO t VALUES (1, 'a'); BEGIN; INSERT INTO t VALUES (2, 'b')")
    text = f"INSERT OR {clause} INTO t VALUES (8, 'h'), (22, 'b'), (9, 'i')"
    if raises:
        with pytest.raises(ConstraintError):
            db.execute(text)
    else:
        db.execute(text)
    assert [r[0] for r in rows(db, "SELECT id FROM t")] == sorted(left, key=repr)
    assert bool(db.store.stack) == (clause != "ROLLBACK")


def test_rows_of_one_statement_conflict_with_each_other(db):
    db.execute("CREATE TABLE t(id INT PRIMARY KEY, u TEXT)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t VALUES (1, 'a'), (1, 'b')")
    db.execute("INSERT OR IGNORE INTO t VALUES (1, 'first'), (1, 'second')")
    db.execute("INSERT OR REPLACE INTO t VALUES (2, 'first'), (2, 'last'), (3, 'x')")
    db.execute("INSERT INTO t VALUES (3, 'y'), (3, 'z'), (4, 'n') ON CONFLICT (id) DO UPDATE SET u = t.u || excluded.u")
    assert rows(db, "SELECT * FROM t") == [(1, "first"), (2, "last"), (3, "xz"), (4, "n")]
    db.execute("INSERT INTO t VALUES (3, 'q') ON CONFLICT DO NOTHING; REPLACE INTO t VALUES (4, 'r')")
    assert rows(db, "SELECT u FROM t WHERE id > 2") == [("r",), ("xz",)]


def test_replace_makes_foreign_keys_react(db):
    db.execute("CREATE TABLE p(k INT PRIMARY KEY, u TEXT UNIQUE); CREATE TABLE c(i INT, k INT REFERENCES p ON DELETE CASCADE); INSERT INTO p VALUES (1, 'a'), (2, 'b'); INSERT INTO c VALUES (10, 1), (20, 2)")
    db.execute("REPLACE INTO p VALUES (3, 'a')")
    assert rows(db, "SELECT * FROM p") == [(2, "b"), (3, "a")] and rows(db, "SELECT * FROM c") == [(20, 2)]


def test_update(db):
    db.execute("CREATE TABLE t(id INT PRIMARY KEY, n TEXT, u INT UNIQUE); INSERT INTO t VALUES (1, 'a', 1), (2, 'b', 2), (3, 'c', 3); CREATE TABLE s(k INT, x TEXT); INSERT INTO s VALUES (1, 'q'), (1, 'p'), (2, 'r'), (NULL, 'z')")
    assert rows(db, "UPDATE t SET (n, u) = (upper(n), u + 10) WHERE id IN (SELECT k FROM s) RETURNING id, n") == [(1, "A"), (2, "B")]
    db.execute("UPDATE t AS y SET n = s.x FROM s, (SELECT 1 AS one) o WHERE s.k = y.id AND one = 1")
    assert rows(db, "SELECT * FROM t") == [(1, "p", 11), (2, "r", 12), (3, "c", 3)]
    with pytest.raises(ConstraintError):
        db.execute("UPDATE t SET u = 3 WHERE id = 1")
    with pytest.raises(ConstraintError):
        db.execute("UPDATE t SET id = 7")
    db.execute("UPDATE OR IGNORE t SET u = 3")
    assert rows(db, "SELECT u FROM t") == [(11,), (12,), (3,)]
    db.execute("UPDATE OR REPLACE t SET u = 3 WHERE id = 2")
    assert rows(db, "SELECT id, u FROM t") == [(1, 11), (2, 3)]
    db.execute("WITH c AS (SELECT id FROM t WHERE u = 3) DELETE FROM t WHERE id IN (SELECT id FROM c)")
    assert rows(db, "SELECT id FROM t") == [(1,)]


@pytest.mark.parametrize("action,child", [("CASCADE", [(10, 5), (11, 2), (12, None)]), ("SET NULL", [(10, None), (11, 2), (12, None)]), ("SET DEFAULT", [(10, 2), (11, 2), (12, None)]), ("RESTRICT", None), ("NO ACTION", None)])
def test_foreign_keys_on_update(db, action, child):
    db.execute(f"CREATE TABLE p(k INT PRIMARY KEY, v TEXT); INSERT INTO p VALUES (1, 'a'), (2, 'b'); CREATE TABLE c(i INT, k INT DEFAULT 2 REFERENCES p(k) ON UPDATE {action}); INSERT INTO c VALUES (10, 1), (11, 2), (12, NULL)")
    db.execute("UPDATE p SET v = 'z'")  # no key changes
    if child is None:
        with pytest.raises(ConstraintError):
            db.execute("UPDATE p SET k = 5 WHERE k = 1")
        child = [(10, 1), (11, 2), (12, None)]
    else:
        db.execute("UPDATE p SET k = 5 WHERE k = 1")
        assert rows(db, "SELECT k FROM p") == [(2,), (5,)]
    assert rows(db, "SELECT * FROM c") == child


def test_foreign_key_actions_are_checked_themselves(db):
    db.execute("CREATE TABLE p(k INT PRIMARY KEY); INSERT INTO p VALUES (1), (2)")
    db.execute("CREATE TABLE a(k INT NOT NULL REFERENCES p ON DELETE SET NULL); CREATE TABLE b(k INT DEFAULT 9 REFERENCES p ON DELETE SET DEFAULT ON UPDATE CASCADE); CREATE TABLE d(k INT PRIMARY KEY REFERENCES p ON UPDATE CASCADE); CREATE TABLE e(k INT REFERENCES d ON UPDATE CASCADE)")
    db.execute("INSERT INTO a VALUES (1)")
    with pytest.raises(ConstraintError):
        db.execute("DELETE FROM p WHERE k = 1")  # the child may not be null
    db.execute("DELETE FROM a; INSERT INTO b VALUES (1)")
    with pytest.raises(ConstraintError):
        db.execute("DELETE FROM p WHERE k = 1")  # the default has no parent
    db.execute("DELETE FROM b; INSERT INTO d VALUES (2); INSERT INTO e VALUES (2)")
    db.execute("UPDATE p SET k = 20 WHERE k = 2")  # over two tables
    assert rows(db, "SELECT d.k, e.k FROM d, e") == [(20, 20)]
    with pytest.raises(ConstraintError):
        db.execute("DROP TABLE p")
    db.execute("PRAGMA foreign_keys = OFF; DELETE FROM p WHERE k = 20")
    assert rows(db, "PRAGMA foreign_key_check") == [("d", "p", 0, 1)] and rows(db, "PRAGMA foreign_keys") == [(0,)]


def test_deferred_foreign_keys(db):
    db.execute("CREATE TABLE p(k INT PRIMARY KEY); CREATE TABLE c(k INT REFERENCES p DEFERRABLE INITIALLY DEFERRED)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO c VALUES (1)")  # outside a transaction at once
    db.execute("BEGIN; INSERT INTO c VALUES (1)")
    with pytest.raises(ConstraintError):
        db.execute("COMMIT")
    db.execute("INSERT INTO p VALUES (1); COMMIT; BEGIN; DELETE FROM p; INSERT INTO p VALUES (1); COMMIT")
    assert rows(db, "SELECT * FROM c") == [(1,)]


def test_alter_keeps_metadata(db):
    db.execute("CREATE TABLE p(a INT PRIMARY KEY, b TEXT DEFAULT 'd', c INT CHECK (c > 0), u INT UNIQUE); CREATE TABLE q(x INT REFERENCES p(a) ON UPDATE CASCADE); CREATE INDEX i ON p(b, c); INSERT INTO p VALUES (1, 'x', 1, 1); INSERT INTO q VALUES (1)")
    db.execute("CREATE TRIGGER t AFTER UPDATE OF c ON p BEGIN INSERT INTO q VALUES (NULL); END")
    for a, b in (("a", "aa"), ("b", "bb"), ("c", "cc"), ("u", "uu")):
        db.execute(f"ALTER TABLE p RENAME COLUMN {a} TO {b}")
    db.execute("ALTER TABLE p RENAME TO r")
    db.execute("INSERT INTO r(aa, cc, uu) VALUES (2, 5, 2); UPDATE r SET aa = 7 WHERE aa = 1; UPDATE r SET cc = 6 WHERE aa = 2")
    assert rows(db, "SELECT aa, bb FROM r") == [(2, "d"), (7, "x")] and rows(db, "SELECT * FROM q") == [(7,), (None,)]
    for bad in ("INSERT INTO r VALUES (3, 'x', 0, 3)", "INSERT INTO r VALUES (3, 'x', 1, 2)", "INSERT INTO r VALUES (2, 'x', 1, 9)", "INSERT INTO q VALUES (99)", "ALTER TABLE r DROP COLUMN cc", "ALTER TABLE r DROP COLUMN aa", "ALTER TABLE r DROP COLUMN bb"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    assert rows(db, "PRAGMA index_info(i)") == [(0, 1, "bb"), (1, 2, "cc")]
    db.execute("ALTER TABLE r ADD COLUMN z REAL DEFAULT 1.5 CHECK (z < 2); ALTER TABLE r ADD y TEXT; ALTER TABLE r DROP COLUMN y")
    assert rows(db, "SELECT z FROM r") == [(1.5,), (1.5,)]
    db.execute("DROP INDEX i; ALTER TABLE r DROP COLUMN bb; DROP TABLE q; DROP TABLE r")
    assert db.store.tables == {} and db.store.triggers == [] and db.store.indexes == {}


def test_triggers(db):
    db.execute("CREATE TABLE t(id INT PRIMARY KEY, n TEXT); CREATE TABLE log(what TEXT, id INT); INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    db.execute("CREATE TRIGGER u AFTER UPDATE OF n ON t WHEN NEW.id > 1 BEGIN INSERT INTO log VALUES (OLD.n || '>' || NEW.n, NEW.id); END; CREATE TRIGGER i BEFORE INSERT ON t BEGIN INSERT INTO log SELECT 'new', count(*) FROM t WHERE id < NEW.id; END")
    db.execute("CREATE TRIGGER d AFTER DELETE ON t BEGIN UPDATE log SET what = 'gone' WHERE id = OLD.id; DELETE FROM log WHERE id = OLD.id + 1; END")
    db.execute("UPDATE t SET n = n || '!'; UPDATE t SET id = id")
    assert rows(db, "SELECT * FROM log") == [("b>b!", 2), ("c>c!", 3)]
    db.execute("DELETE FROM t WHERE id = 2; INSERT INTO t VALUES (9, 'z')")
    assert rows(db, "SELECT * FROM log") == [("gone", 2), ("new", 2)]
    db.execute("CREATE TRIGGER no BEFORE DELETE ON t BEGIN SELECT RAISE(ABORT, 'stays') WHERE OLD.id = 9; END")
    with pytest.raises(ConstraintError, match="stays"):
        db.execute("DELETE FROM t")
    db.execute("DELETE FROM t WHERE id = 1; DROP TRIGGER no; DROP TRIGGER IF EXISTS no; DELETE FROM t WHERE id = 9")
    assert rows(db, "SELECT id FROM t") == [(3,)]
    for bad in ("DROP TRIGGER no", "CREATE TRIGGER u AFTER DELETE ON t BEGIN SELECT 1; END", "CREATE TRIGGER x INSTEAD OF DELETE ON t BEGIN SELECT 1; END"):
        with pytest.raises(ValueError):
            db.execute(bad)


def test_views(db):
    db.execute("CREATE TABLE t(id INT PRIMARY KEY, n TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b'); CREATE VIEW v(i, m) AS SELECT id, n FROM t WHERE id > 1; CREATE VIEW IF NOT EXISTS w AS SELECT m || '?' AS q FROM v")
    assert rows(db, "SELECT * FROM w") == [("b?",)]
    with pytest.raises(ValueError):
        db.execute("INSERT INTO v VALUES (5, 'e')")
    db.execute("CREATE TRIGGER vi INSTEAD OF INSERT ON v BEGIN INSERT INTO t VALUES (NEW.i, NEW.m); END; CREATE TRIGGER vu INSTEAD OF UPDATE ON v BEGIN UPDATE t SET n = NEW.m WHERE id = OLD.i; END; CREATE TRIGGER vd INSTEAD OF DELETE ON v BEGIN DELETE FROM t WHERE id = OLD.i; END")
    db.execute("INSERT INTO v VALUES (5, 'e'); INSERT INTO v(m, i) SELECT 'f', 6; UPDATE v SET m = m || '+' WHERE i < 6; DELETE FROM v WHERE i = 6")
    assert rows(db, "SELECT * FROM t") == [(1, "a"), (2, "b+"), (5, "e+")]
    assert rows(db, "SELECT type, name, tbl_name FROM any_master WHERE type <> 'trigger'") == [("table", "t", "t"), ("view", "v", "v"), ("view", "w", "w")]


def test_transactions(db):
    db.execute("CREATE TABLE t(id INT); BEGIN; INSERT INTO t VALUES (1); SAVEPOINT a; INSERT INTO t VALUES (2); CREATE TABLE x(a INT); ROLLBACK TO SAVEPOINT a; INSERT INTO t VALUES (3); RELEASE a; COMMIT")
    assert rows(db, "SELECT * FROM t") == [(1,), (3,)] and "x" not in db.store.tables
    db.execute("BEGIN IMMEDIATE; DELETE FROM t; CREATE VIEW v AS SELECT * FROM t; ROLLBACK TRANSACTION; SAVEPOINT s; INSERT INTO t VALUES (4); RELEASE s")
    assert rows(db, "SELECT count(*) FROM t") == [(3,)] and not db.store.stack and not db.store.views
    for bad in ("COMMIT", "ROLLBACK", "RELEASE s", "BEGIN; BEGIN"):
        with pytest.raises(ValueError):
            db.execute(bad)


def test_pragmas_and_maintenance(db):
    db.execute("CREATE TABLE t(a INT PRIMARY KEY, b TEXT UNIQUE DEFAULT 'x', c INT AS (a + 1) STORED, d REAL NOT NULL); CREATE INDEX i ON t(b, d); CREATE UNIQUE INDEX j ON t(d); INSERT INTO t(a, b, d) VALUES (1, 'p', 0.5), (2, 'q', 1.5), (3, NULL, 2.5)")
    assert rows(db, "PRAGMA table_xinfo(t)") == [(0, "a", "bigint", 0, None, 1, 0), (1, "b", "string", 0, "'x'", 0, 0), (2, "c", "bigint", 0, None, 0, 3), (3, "d", "double", 1, None, 0, 0)]
    assert [r[:6] for r in rows(db, "PRAGMA table_xinfo(t)")] == rows(db, "PRAGMA table_info('t')")
    assert rows(db, "PRAGMA user_version") == [(0,)] and rows(db, "PRAGMA user_version = 42; PRAGMA user_version") == [(42,)]
    assert rows(db, "PRAGMA index_list(t)") == [(0, "i", 0, "c", 0), (1, "j", 1, "c", 0), (2, "autoindex_t_1", 1, "pk", 0), (3, "autoindex_t_2", 1, "u", 0)]
    assert rows(db, "PRAGMA index_info(i)") == [(0, 1, "b"), (1, 3, "d")]
    assert rows(db, "PRAGMA integrity_check") == [("ok",)] and len(rows(db, "PRAGMA compile_options")) > 3
    assert [r[:2] + r[3:] for r in rows(db, "PRAGMA stats")] == [("t", "i", 3, 0), ("t", "j", 3, 0), ("t", None, 3, 0)]
    assert rows(db, "PRAGMA journal_mode") == [("memory",)] and rows(db, "PRAGMA main.journal_mode = wal") == [("wal",)] and rows(db, "PRAGMA encoding") == [("UTF-8",)]
    assert rows(db, "ANALYZE t") == [("t", "i", "3 1 1"), ("t", "j", "3 1")] == rows(db, "ANALYZE")
    t = db.store.tables["t"]
    db.store.tables["t"] = stores.replace(t, df=t.df.unionAll(t.df.where("a = 1")))
    assert rows(db, "PRAGMA integrity_check") == [("UNIQUE constraint failed: t.a",), ("UNIQUE constraint failed: t.b",), ("UNIQUE constraint failed: t.d",)]
    for text in ("REINDEX", "REINDEX t", "REINDEX j"):
        with pytest.raises(ConstraintError):
            db.execute(text)
    db.execute("REINDEX i; VACUUM")
    assert rows(db, "SELECT count(*) FROM t") == [(4,)]
    assert any("Scan" in r[1] for r in rows(db, "EXPLAIN QUERY PLAN SELECT a FROM t WHERE a = 1"))


def test_copies(db, spark):
    db.execute("CREATE TABLE t(a INT); INSERT INTO t VALUES (1), (2)")
    path = shared_path(spark, "copy")
    db.execute(f"VACUUM INTO '{path}'")
    other = Database(spark)
    other.execute(f"ATTACH DATABASE '{path}' AS aux; CREATE TABLE t(a INT); INSERT INTO t SELECT a + 10 FROM aux.t")
    assert rows(other, "SELECT x.a, y.a FROM aux.t AS x JOIN main.t AS y ON x.a + 10 = y.a") == [(1, 11), (2, 12)]
    assert rows(other, "PRAGMA database_list") == [(0, "main"), (1, "aux")]
    other.execute("DETACH aux")
    assert rows(other, "PRAGMA database_list") == [(0, "main")]


def test_counters(db):
    assert (db.changes(), db.total_changes(), db.last_insert_id()) == (0, 0, None)
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, n INT); INSERT INTO t(n) VALUES (1), (2), (3)")
    assert (db.changes(), db.changes(), db.total_changes(), db.last_insert_id()) == (3, 3, 3, 3)
    db.execute("UPDATE t SET n = 0 WHERE id > 1; DELETE FROM t WHERE id = 1; INSERT INTO t(id, n) VALUES (40, 4)")
    assert (db.total_changes(), db.changes(), db.total_changes(), db.last_insert_id()) == (7, 1, 7, 40)
    db.execute("DELETE FROM t WHERE id = 999")
    assert (db.changes(), db.total_changes()) == (0, 7)
    db.execute("CREATE TABLE log(id INT); CREATE TRIGGER g AFTER DELETE ON t BEGIN INSERT INTO log VALUES (OLD.id); INSERT INTO log VALUES (0); END; DELETE FROM t WHERE id = 40")
    assert (db.changes(), db.total_changes()) == (1, 10)


def test_virtual_tables_and_recursion(db):
    db.execute("CREATE VIRTUAL TABLE s USING series(1, 10, 3)")
    assert rows(db, "SELECT * FROM s") == [(1,), (4,), (7,)]
    assert rows(db, "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 5) SELECT sum(i), max(value) FROM n, s") == [(45, 7)]
    with pytest.raises(SqlError):
        db.execute("CREATE VIRTUAL TABLE x USING nothing(1)")


def test_authorizer_trace_and_hooks(db):
    seen, told = [], []
    db.store.hook("trace", told.append)
    db.store.hook("update", lambda s, t: seen.append(t))
    db.execute("CREATE TABLE t(a INT, b INT); INSERT INTO t VALUES (1, 2)")
    db.store.authorizer = lambda action, *names: "deny" if (action, *names) == ("delete", "t") else "ignore" if action == "update" and "b" in names else "ok"
    with pytest.raises(NotAuthorizedError):
        db.execute("DELETE FROM t")
    db.execute("UPDATE t SET b = 9; UPDATE t SET a = 5")
    assert rows(db, "SELECT * FROM t") == [(5, 2)]
    assert told[:2] == ["CREATE TABLE t(a INT, b INT)", "INSERT INTO t VALUES (1, 2)"] and seen == ["t", "t"]


def test_extensions(db, spark, monkeypatch):
    monkeypatch.setattr(stores, "AUTO_EXTENSIONS", [])
    stores.register_extension("notes", lambda s: s.create("notes", spark.createDataFrame([], "n string")), auto=True)
    stores.register_extension("more", lambda s: s.settings.__setitem__("more", 1))
    s = Store(spark)
    assert "notes" in s.tables and "more" not in s.settings
    stores.load_extension(s, "more")
    assert s.settings["more"] == 1
    with pytest.raises(ValueError):
        stores.load_extension(s, "none")


def test_functions(spark):
    f = Functions(spark)
    f.scalar("area", lambda r: r * r * 3, "double", 1)
    f.scalar("area", lambda a, b: a * b, "double", 2)
    f.scalar("area", lambda *v: sum(v), "double")
    text = f.resolve("SELECT area(2.0D) AS a, area(2.0D, abs(-3.0D)) AS b, area(1.0D, 2.0D, (3.0D)) AS c, 'area(1)' AS d")
    assert tuple(spark.sql(text).first()) == (12.0, 6.0, 6.0, "area(1)")
    with pytest.raises(LookupError):
        Functions(spark).lookup("area", 1)
    f.aggregate("mean", Aggregate(lambda: [0.0, 0], lambda s, x: s if x is None else [s[0] + x, s[1] + 1], lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda s: s[0] / s[1] if s[1] else None, "double"))
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, None), (None, 5.0)] * 50, "k int, x double").repartition(7)
    assert sorted(map(tuple, f.grouped(df, ["k"], m=("mean", "x"), n=("mean", F.col("x") + 1)).collect()), key=repr) == [(1, 3.0, 4.0), (2, None, None), (None, 5.0, 6.0)]
    assert f.grouped(df.where("false"), [], m=("mean", "x")).collect()[0].m is None and f.grouped(df.where("false"), ["k"], m=("mean", "x")).count() == 0


def test_dialect():
    assert " ".join(to_spark("a IS NOT 5 AND b IS NOT NULL AND c GLOB d.e || '*'").split()).startswith("a IS DISTINCT FROM 5 AND b IS NOT NULL AND c RLIKE concat(")
    assert to_spark("x GLOB 'a*' AND y = 'it''s \\n'") == "x RLIKE '^a[\\\\s\\\\S]*$' AND y = 'it\\'s \\\\n'"
    assert not complete("SELECT (1;") and not complete(";") and not complete("-- SELECT 1;") and complete("SELECT ');';")
    assert split("; SELECT 1 -- a;b\n; /* ; */") == ["SELECT 1 -- a;b"]


def test_json_members(spark):
    docs = spark.createDataFrame([(' [1,"x",{"a":[2]},null]',), ('{"k":1,"l":"m"}',), ("5",), (None,), ("[]",)], "j string")
    got = docs.select(F.explode(J.each(F.col("j"))).alias("e")).select("e.*").collect()
    assert [tuple(r) for r in got] == [("0", "1"), ("1", "x"), ("2", '{"a":[2]}'), ("3", None), ("k", "1"), ("l", "m")]


def test_workers_elsewhere_import_the_package_that_is_shipped(tmp_path):
    """A session in another folder, without this one on its workers' path."""
    code = """
import sys
sys.path.insert(0, {root!r})
from quern.session import builder, ship
spark = builder("ship", spark__master="local[2]", spark__ui__enabled="false").getOrCreate()
sys.path.pop(0)
ship(spark)
from quern.sources import series
print("rows", series.series(spark, 0, 10, 1).count())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(stores.__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "rows 10" in done.stdout, done.stderr[-2000:]


def test_shared_tables_lie_in_the_folder_of_the_application(spark):
    made = shared_table(spark.range(3), "numbers")
    assert made._quern_path.startswith(f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}/numbers-") and made.count() == 3
