"""PRAGMAs and the catalog of a store as DataFrames; statistics and compaction."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import SETTINGS
from quern.shared import shared_path, write
from quern.store import Expr, Store

#: Bytes of a file that compaction aims at.
FILE_BYTES = 128 << 20
#: Settings of storage that snapshots have no use for; they are kept and told as given.
STORAGE = {"journal_mode": "memory", "synchronous": 2, "cache_size": 2000, "page_size": 4096, "auto_vacuum": 0, "encoding": "UTF-8"}


def run(store: Store, name: str, value: str | None = None) -> DataFrame:
    """The rows of ``PRAGMA name``, ``PRAGMA name = value`` or ``PRAGMA name(value)``."""
    table = next((n for n in store.tables if value is not None and n.lower() == value.lower()), value)
    if name == "table_info":
        return table_info(store, table).drop("hidden")
    if name == "table_xinfo":
        return table_info(store, table)
    if name == "user_version":
        if value is not None:
            store.settings[name] = int(value)
        return _one(store, name, int(store.settings[name]), "long")
    if name == "foreign_keys":
        if value is not None and not store.stack:  # inside a transaction it has no effect
            store.foreign_keys = value.lower() in ("1", "on", "true", "yes")
        return _one(store, name, int(store.foreign_keys), "int")
    if name == "foreign_key_list":
        return store.foreign_key_list().where(F.col("tbl") == table)
    if name == "foreign_key_check":
        return foreign_key_check(store, table)
    if name == "database_list":
        return store.database_list()
    if name == "index_list":
        return index_list(store, table)
    if name == "index_info":
        return index_info(store, value)
    if name == "integrity_check":
        return integrity_check(store)
    if name == "compile_options":
        return store.spark.createDataFrame([(f"{k}={v}",) for k, v in sorted(SETTINGS.items())], "compile_options string")
    if name == "stats":
        return stats(store)
    if name == "page_count":
        size = sum(_bytes(t.df) for t in store.tables.values())
        return _one(store, name, -(-size // int(store.settings.get("page_size", STORAGE["page_size"]))), "long")
    if name in STORAGE:
        if value is not None:
            store.settings[name] = value
        return _one(store, name, str(store.settings.get(name, STORAGE[name])), "string")
    raise ValueError(f"unknown pragma: {name}")


def _one(store: Store, name: str, value, kind: str) -> DataFrame:
    return store.spark.createDataFrame([(value,)], f"{name} {kind}")


def _bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 62)


def master(store: Store) -> DataFrame:
    """(type, name, tbl_name) of tables, views, indexes and triggers."""
    rows = [("table", n, n) for n in store.tables] + [("view", n, n) for n in store.views]
    rows += [("index", n, t) for n, (t, _, _) in store.indexes.items()] + [("trigger", t.name, t.table) for t in store.triggers]
    return store.spark.createDataFrame(rows, "type string, name string, tbl_name string")


def table_info(store: Store, table: str) -> DataFrame:
    """(cid, name, type, notnull, dflt_value, pk, hidden); hidden is 3 for a generated column, else 0."""
    if table not in store.tables:
        raise ValueError(f"no such table: {table}")
    t = store.tables[table]

    def default(c: str) -> str | None:
        value = t.defaults.get(c)
        return None if value is None else value.text if isinstance(value, Expr) else str(value)

    rows = [(k, f.name, f.dataType.simpleString(), int(f.name in t.not_null), default(f.name), t.primary.index(f.name) + 1 if f.name in t.primary else 0, 3 if f.name in t.generated else 0) for k, f in enumerate(t.df.schema.fields)]
    return store.spark.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int, hidden int")


def index_list(store: Store, table: str) -> DataFrame:
    """(seq, name, unique, origin, partial) of a table's indexes, and of its keys that are constraints."""
    if table not in store.tables:
        raise ValueError(f"no such table: {table}")
    t = store.tables[table]
    own = [(n, int(u), "c") for n, (x, _, u) in store.indexes.items() if x == table]
    made = [c for x, c, u in store.indexes.values() if x == table and u]
    keys = [k for k in t.unique if k not in made]
    auto = [(f"autoindex_{table}_{k + 1}", 1, o) for k, o in enumerate(["pk"] * bool(t.primary) + ["u"] * len(keys))]
    rows = [(k, n, u, o, 0) for k, (n, u, o) in enumerate([*own, *auto])]
    return store.spark.createDataFrame(rows, "seq int, name string, `unique` int, origin string, partial int")


def index_info(store: Store, index: str) -> DataFrame:
    """(seqno, cid, name) of an index's columns."""
    if index not in store.indexes:
        raise ValueError(f"no such index: {index}")
    table, columns, _ = store.indexes[index]
    have = store.tables[table].df.columns
    return store.spark.createDataFrame([(k, have.index(c), c) for k, c in enumerate(columns)], "seqno int, cid int, name string")


def foreign_key_check(store: Store, table: str | None = None) -> DataFrame:
    """(tbl, parent, fkid, n): foreign keys that rows without a parent break, and how many rows."""
    parts = [
        store.orphans(t.df, fk).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(n).alias("tbl"), F.lit(fk.parent).alias("parent"), F.lit(k).alias("fkid"), "n")
        for n, t in store.tables.items() if table in (None, n) for k, fk in enumerate(t.foreign)
    ]
    return reduce(DataFrame.unionAll, parts) if parts else store.spark.createDataFrame([], "tbl string, parent string, fkid int, n long")


def integrity_check(store: Store) -> DataFrame:
    """(integrity_check): ok, or a row a constraint that rows of a table break.  One job."""
    found = store.broken()
    good = store.spark.createDataFrame([("ok",)], "integrity_check string").join(found.limit(1), how="left_anti")
    return found.select(F.col("problem").alias("integrity_check")).unionAll(good)


def stats(store: Store) -> DataFrame:
    """(tbl, idx, wdth, hght, flgs) of tables and indexes: bytes of a row as the optimizer takes them from the types, and rows."""
    parts = []
    for name, t in store.tables.items():
        rows = t.df.agg(F.count("*").alias("n"))
        for idx in [None, *(n for n, (x, _, _) in store.indexes.items() if x == name)]:
            columns = store.indexes[idx][1] if idx else t.df.columns
            width = F.lit(t.df.select(*columns)._jdf.schema().defaultSize()).cast("long")
            parts.append(rows.select(F.lit(name).alias("tbl"), F.lit(idx).cast("string").alias("idx"), width.alias("wdth"), F.col("n").alias("hght"), F.lit(0).alias("flgs")))
    return reduce(DataFrame.unionAll, parts) if parts else store.spark.createDataFrame([], "tbl string, idx string, wdth long, hght long, flgs int")


def analyze(store: Store, table: str | None = None) -> DataFrame:
    """(tbl, idx, stat): rows, and for an index the average rows that agree on its first 1, 2, ... columns.

    One aggregate a table; distinct values are counted exactly.
    """
    parts = []
    for name, t in store.tables.items():
        if table not in (None, name):
            continue
        indexes = {n: c for n, (x, c, _) in store.indexes.items() if x == name}
        prefixes = {c[: k + 1] for c in indexes.values() for k in range(len(c))}
        number = {p: f"d{k}" for k, p in enumerate(sorted(prefixes))}
        counts = t.df.agg(F.count("*").alias("n"), *[F.count_distinct(F.struct(*p)).alias(d) for p, d in number.items()])
        share = lambda d: F.ceil(F.col("n") / F.greatest(F.col(d), F.lit(1))).cast("string")
        kinds = [(None, [])] if not indexes else [(n, [share(number[c[: k + 1]]) for k in range(len(c))]) for n, c in indexes.items()]
        parts += [counts.select(F.lit(name).alias("tbl"), F.lit(idx).cast("string").alias("idx"), F.concat_ws(" ", F.col("n").cast("string"), *more).alias("stat")) for idx, more in kinds]
    return reduce(DataFrame.unionAll, parts) if parts else store.spark.createDataFrame([], "tbl string, idx string, stat string")


def rewritten(df: DataFrame, name: str) -> DataFrame:
    """The live rows in files of about FILE_BYTES by the optimizer's estimate."""
    path = shared_path(df.sparkSession, name)
    files = max(1, -(-_bytes(df) // FILE_BYTES))
    write(df.coalesce(min(files, 1_000_000)), path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compact(store: Store) -> None:
    """Every table written anew, which cuts its lineage."""
    for name, t in list(store.tables.items()):
        store.tables[name] = replace(t, df=rewritten(t.df, "vacuum"), age=0)
