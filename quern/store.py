"""Tables as snapshots: DML, transactions, savepoints, constraints, foreign keys, triggers and schema changes.

A table is an immutable DataFrame; a statement builds the next one and swaps a pointer in a dictionary on the driver.
Nothing is computed until a table is read, but what a constraint must look at: a statement looks at the rows it touches (new keys
are looked up in the others), only for constraints on columns that it changes, and all in one job.  A statement that fails
changes nothing.  A transaction keeps the dictionary it began with.  After ``CUT`` statements a table's lineage is cut by
writing it to the shared folder, as plans grow with every statement.

Where SQL goes row by row, a statement here goes by sets.  Where order decides (which of two new rows with one key stays),
rows count in the order in which they are read.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.shared import shared_table, write

#: Statements after which a table is written; one that reads the table several times counts as THRICE.
CUT, THRICE = 5, 3


class ConstraintError(ValueError):
    """A statement would break a constraint; nothing has changed (with FAIL: no row from the first that breaks it on)."""


class NotAuthorizedError(PermissionError):
    """The authorizer denied an action."""


@dataclass(frozen=True)
class Expr:
    """A default that is a SQL expression."""

    text: str


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "restrict"  # restrict, no action, cascade, set null, set default
    on_update: str = "no action"
    deferred: bool = False  # in a transaction, looked at by COMMIT


@dataclass(frozen=True)
class Table:
    df: DataFrame
    primary: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)
    foreign: tuple[ForeignKey, ...] = ()
    generated: dict = field(default_factory=dict)  # column -> SQL expression over the others
    age: int = 0

    def keys(self, columns: set[str] | None = None) -> list[tuple[str, ...]]:
        """Primary and unique keys (those with one of ``columns``)."""
        return [k for k in (*([self.primary] if self.primary else []), *self.unique) if columns is None or columns & set(k)]


@dataclass(frozen=True)
class Trigger:
    name: str
    time: str  # before, after, instead of
    event: str  # insert, update, delete
    table: str
    #: ``body(store)`` or ``body(store, changes)`` once a statement, or SQL statements.  Changes have the structs old and new.
    body: Callable | str
    columns: tuple[str, ...] = ()  # UPDATE OF
    when: str | None = None


def _matches(on: str | Column | None) -> Column:
    if on is None:
        return F.lit(True)
    return F.coalesce(F.expr(on) if isinstance(on, str) else on, F.lit(False))


def _all_set(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _renamed(expression: str, column: str, to: str) -> str:
    return re.sub(rf"(?<![\w.'\"]){re.escape(column)}(?![\w('\"])", to, expression)


class Store:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        # snapshots are unions of what stayed and what is new, whose partitions need not be as many
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        self.triggers: list[Trigger] = []
        self.stack: list[tuple[str | None, tuple]] = []
        #: Name -> (table, columns, unique): metadata alone, as scans are pruned by Parquet statistics.
        self.indexes: dict[str, tuple[str, tuple[str, ...], bool]] = {}
        self.hooks: dict[str, list[Callable]] = {"commit": [], "rollback": [], "update": [], "trace": []}
        self.authorizer: Callable[..., str] | None = None
        self.foreign_keys = True
        self.settings: dict[str, object] = {"user_version": 0}
        self._touched: DataFrame | None = None  # by the last statement, and how many rows if that is known
        self._n: int | None = 0
        self._uncounted: list[DataFrame] = []
        self._counted = 0
        for init in AUTO_EXTENSIONS:
            init(self)

    # -- reading and schema ---------------------------------------------------------------

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name].df

    def authorize(self, action: str, *names: str) -> bool:
        """False if the authorizer ignores the action; an error if it denies it."""
        said = self.authorizer(action, *names) if self.authorizer else "ok"
        if said == "deny":
            raise NotAuthorizedError(f"not authorized: {action} {' '.join(names)}")
        return said != "ignore"

    def trace(self, text: str) -> None:
        for body in self.hooks["trace"]:
            body(text)

    def create(self, name: str, df: DataFrame, *, if_not_exists: bool = False, **constraints) -> None:
        if name in self.tables or name in self.views:
            if if_not_exists:
                return
            raise ValueError(f"table {name} already exists")
        if not self.authorize("create table", name):
            return
        table = Table(df, **constraints)
        self.tables[name] = table
        try:
            self._check(name, table.df, None)
        except ConstraintError:
            del self.tables[name]
            raise

    def drop(self, name: str, if_exists: bool = False) -> None:
        """Rows that refer to the table's rows make foreign keys react, as if all rows were deleted."""
        if name not in self.tables:
            if if_exists:
                return
            raise ValueError(f"no such table: {name}")
        if not self.authorize("drop table", name):
            return
        before = self.tables
        self.tables = dict(before)
        try:
            if any(fk.parent == name for n, t in self.tables.items() if n != name for fk in t.foreign):
                t = self.tables[name]
                self._change(name, t.df.where("false"), changes=t.df.select(F.struct(*t.df.columns).alias("old"), F.lit(None).alias("new")))
        except ConstraintError:
            self.tables = before
            raise
        del self.tables[name]
        self.indexes = {n: i for n, i in self.indexes.items() if i[0] != name}
        self.triggers = [t for t in self.triggers if t.table != name]

    def rename(self, name: str, to: str) -> None:
        if to in self.tables or to in self.views:
            raise ValueError(f"there is already a table named {to}")
        parent = lambda fk: replace(fk, parent=to) if fk.parent == name else fk
        self.tables = {to if n == name else n: replace(t, foreign=tuple(map(parent, t.foreign))) for n, t in self.tables.items()}
        self.indexes = {n: (to if t == name else t, c, u) for n, (t, c, u) in self.indexes.items()}
        self.triggers = [replace(t, table=to) if t.table == name else t for t in self.triggers]

    def add_column(self, name: str, column: str, kind: str, default=None, check: str | None = None, not_null: bool = False) -> None:
        t = self.tables[name]
        if column in t.df.columns:
            raise ValueError(f"duplicate column name: {column}")
        if not_null and default is None:
            raise ConstraintError(f"a NOT NULL column needs a default: {column}")
        defaults = {**t.defaults, column: default} if default is not None else t.defaults
        more = {"checks": (*t.checks, *([check] if check else [])), "not_null": (*t.not_null, *([column] if not_null else []))}
        new = replace(t, df=t.df.withColumn(column, _default(default).cast(kind)), defaults=defaults, **more)
        self.tables[name] = new
        try:
            if check:
                self._check(name, new.df, None, {column})
        except ConstraintError:
            self.tables[name] = t
            raise

    def rename_column(self, name: str, column: str, to: str) -> None:
        """The new name holds in keys, checks, defaults, foreign keys of both sides, indexes and triggers."""
        t = self.tables[name]
        if column not in t.df.columns:
            raise ValueError(f"no such column: {column}")
        if to in t.df.columns:
            raise ValueError(f"duplicate column name: {to}")
        new = lambda columns: tuple(to if c == column else c for c in columns)
        text = lambda e: _renamed(e, column, to)
        self.tables[name] = replace(
            t,
            df=t.df.withColumnRenamed(column, to),
            primary=new(t.primary),
            not_null=new(t.not_null),
            unique=tuple(map(new, t.unique)),
            checks=tuple(map(text, t.checks)),
            defaults={to if c == column else c: v for c, v in t.defaults.items()},
            foreign=tuple(replace(fk, columns=new(fk.columns)) for fk in t.foreign),
            generated={to if c == column else c: text(e) for c, e in t.generated.items()},
        )
        parent = lambda fk: replace(fk, parent_columns=new(fk.parent_columns)) if fk.parent == name else fk
        self.tables = {n: replace(x, foreign=tuple(map(parent, x.foreign))) for n, x in self.tables.items()}
        self.indexes = {n: (x, new(c) if x == name else c, u) for n, (x, c, u) in self.indexes.items()}
        self.triggers = [replace(x, columns=new(x.columns)) if x.table == name else x for x in self.triggers]

    def drop_column(self, name: str, column: str) -> None:
        """An error if a key, check, index, generated column or foreign key needs the column."""
        t = self.tables[name]
        if column not in t.df.columns:
            raise ValueError(f"no such column: {column}")
        uses = [*t.checks, *(e for c, e in t.generated.items() if c != column)]
        needed = (
            column in t.primary
            or any(column in k for k in t.unique)
            or any(column in fk.columns for fk in t.foreign)
            or any(_renamed(e, column, "") != e for e in uses)
            or any(x == name and column in c for x, c, _ in self.indexes.values())
            or any(fk.parent == name and column in fk.parent_columns for x in self.tables.values() for fk in x.foreign)
        )
        if needed:
            raise ConstraintError(f"cannot drop column {column}: it is in use")
        without = lambda d: {c: v for c, v in d.items() if c != column}
        self.tables[name] = replace(t, df=t.df.drop(column), defaults=without(t.defaults), generated=without(t.generated), not_null=tuple(c for c in t.not_null if c != column))

    def create_index(self, name: str, table: str, columns: list[str], unique: bool = False, if_not_exists: bool = False) -> None:
        """A unique index is a constraint; another one is a note."""
        if name in self.indexes:
            if if_not_exists:
                return
            raise ValueError(f"index {name} already exists")
        if not self.authorize("create index", name, table):
            return
        t = self.tables[table]
        if missing := [c for c in columns if c not in t.df.columns]:
            raise ValueError(f"no such column: {missing[0]}")
        if unique:
            self.tables[table] = replace(t, unique=(*t.unique, tuple(columns)))
            try:
                self._check(table, t.df, None, set(columns))
            except ConstraintError:
                self.tables[table] = t
                raise
        self.indexes[name] = (table, tuple(columns), unique)

    def drop_index(self, name: str, if_exists: bool = False) -> None:
        if name not in self.indexes:
            if if_exists:
                return
            raise ValueError(f"no such index: {name}")
        table, columns, unique = self.indexes.pop(name)
        if unique and table in self.tables:
            t, left = self.tables[table], list(self.tables[table].unique)
            left.remove(columns)
            self.tables[table] = replace(t, unique=tuple(left))

    def reindex(self, name: str | None = None) -> None:
        """Unique indexes (all, a table's or the one named) are looked at again over the whole table."""
        if name is not None and name not in self.tables and name not in self.indexes:
            raise ValueError(f"no such table or index: {name}")
        for index, (table, columns, unique) in self.indexes.items():
            if unique and name in (None, index, table):
                self._check(table, self.tables[table].df, None, set(columns))

    def hook(self, event: str, body: Callable) -> None:
        """``body(store)`` on commit or rollback, ``body(store, table)`` after an insert, update or delete, ``body(text)`` to trace SQL."""
        self.hooks[event].append(body)

    def index_list(self) -> DataFrame:
        rows = [(t, n, ",".join(c), int(u)) for n, (t, c, u) in self.indexes.items()]
        return self.spark.createDataFrame(rows, "tbl string, name string, columns string, is_unique int")

    def foreign_key_list(self) -> DataFrame:
        rows = [(n, fk.parent, a, b, fk.on_delete) for n, t in self.tables.items() for fk in t.foreign for a, b in zip(fk.columns, fk.parent_columns, strict=True)]
        return self.spark.createDataFrame(rows, "tbl string, parent string, col string, parent_col string, on_delete string")

    def database_list(self) -> DataFrame:
        names = ["main", *sorted({n.split(".")[0] for n in self.tables if "." in n})]
        return self.spark.createDataFrame(list(enumerate(names)), "seq int, name string")

    # -- data changes ---------------------------------------------------------------------

    def insert(self, name: str, rows: DataFrame, conflict: str = "abort") -> DataFrame:
        """Append; columns that ``rows`` lacks get their defaults.  The new rows return.

        ``conflict``, on keys and row constraints: abort; ignore the rows that break one; replace the old rows with the same
        key (foreign keys react to their end); fail at the first row that breaks one, those before it stay; rollback the transaction.
        """
        if name in self.views:
            changes = rows.select(F.lit(None).alias("old"), F.struct(*rows.columns).alias("new"))
            self._instead("insert", name, changes)
            return rows
        t = self.tables[name]
        if not self.authorize("insert", name):
            return t.df.where("false")
        if unknown := [c for c in rows.columns if c not in t.df.columns]:
            raise ValueError(f"table {name} has no column named {unknown[0]}")
        full, old, gone, error = self._full(t, rows), t.df, None, None
        if conflict in ("ignore", "replace", "fail"):
            full = shared_table(full.withColumn("__n", F.monotonically_increasing_id()), "rows")  # settles the order that decides
            full = self._again(full, t, last=conflict == "replace")
            if conflict == "replace":
                full = full.where("not __again")
                old, gone = self._parted(t, full)
            else:
                full = self._marked_bad(t, full)
                if conflict == "ignore":
                    full = full.where("not __bad")
                else:
                    first = full.where("__bad").agg(F.min("__n")).first()[0]
                    if first is not None:
                        error, full = ConstraintError(f"constraint failed: {name}"), full.where(F.col("__n") < first)
            full = full.select(*t.df.columns)
        with self._statement(conflict):
            changes = full.select(F.lit(None).alias("old"), F.struct(*t.df.columns).alias("new"))
            self._fire("before", "insert", name, changes)
            if gone is not None and any(fk.parent == name for x in self.tables.values() for fk in x.foreign):
                self._change(name, old, changes=gone.select(F.struct(*t.df.columns).alias("old"), F.lit(None).alias("new")))
                old = self.tables[name].df
            self._change(name, old.unionByName(full), touched=full, rest=old, cost=1 if conflict in ("abort", "rollback") else THRICE)
            self._count(full)
            self._fire("after", "insert", name, changes)
        if error:
            raise error
        return full

    @staticmethod
    def _again(full: DataFrame, t: Table, last: bool) -> DataFrame:
        """New rows, in order of ``__n``, with ``__again``: another one with a key of theirs counts, the first or the ``last``."""
        again = F.lit(False)
        for key in t.keys():
            order = F.col("__n").desc() if last else F.col("__n")
            nth = F.row_number().over(Window.partitionBy(*key, F.when(~_all_set(key), F.col("__n"))).orderBy(order))
            again = again | (nth > 1)
        return full.withColumn("__again", again)

    @staticmethod
    def _parted(t: Table, full: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The table's rows with no key of the new rows, and those with one."""
        if not t.keys():
            return t.df, None
        marked = t.df.withColumn("__hit", F.lit(False))
        for key in t.keys():
            new = full.where(_all_set(key)).select(*key).distinct().withColumn("__also", F.lit(True))
            marked = marked.join(new, list(key), "left").select(*t.df.columns, (F.col("__hit") | F.col("__also").isNotNull()).alias("__hit"))
        return marked.where("not __hit").drop("__hit"), marked.where("__hit").drop("__hit")

    def _marked_bad(self, t: Table, full: DataFrame) -> DataFrame:
        """New rows with ``__bad``: they break a row constraint, or a row of the table or before them has a key of theirs."""
        full = full.withColumn("__bad", ~self._row_good(t) | F.col("__again"))
        for key in t.keys():
            known = t.df.where(_all_set(key)).select(*key).distinct().withColumn("__known", F.lit(True))
            full = full.join(known, list(key), "left").withColumn("__bad", F.col("__bad") | F.col("__known").isNotNull()).drop("__known")
        return full

    def upsert(self, name: str, rows: DataFrame, keys: list[str], update: dict[str, str] | None = None, where: str | None = None) -> DataFrame:
        """ON CONFLICT (keys): nothing without ``update``, else its columns set (``excluded.c`` is the new row's) where ``where`` holds.

        Of several new rows with one key the last counts.  The rows that are new or changed return.
        """
        t = self.tables[name]
        if not self.authorize("insert", name):
            return t.df.where("false")
        full = shared_table(self._full(t, rows).withColumn("__n", F.monotonically_increasing_id()), "rows")  # settles the order that decides
        nth = F.row_number().over(Window.partitionBy(*keys, F.when(~_all_set(keys), F.col("__n"))).orderBy(F.col("__n").desc()))
        full = full.withColumn("__nth", nth).where("__nth = 1").select(*t.df.columns)
        added = full.join(t.df, keys, "left_anti").select(*t.df.columns)
        new = full.where(_all_set(keys)).select(*keys, F.struct(*t.df.columns).alias("excluded"))
        joined = t.df.join(new, keys, "left").select(*t.df.columns, "excluded").alias(name.split(".")[-1])
        hit = F.col("excluded").isNotNull() & _matches(where) if update else F.lit(False)
        marked = joined.select(*t.df.columns, hit.alias("__hit"), F.struct(*[F.expr(e).cast(t.df.schema[c].dataType).alias(c) for c, e in (update or {}).items()] or [F.lit(1).alias("__none")]).alias("__new"))
        with self._statement("abort"):
            return self._update(name, t, marked, list(update or {}), added)

    def update(self, name: str, values: dict[str, str], where: str | Column | None = None, source: DataFrame | None = None, on: list[str] | None = None, conflict: str = "abort") -> DataFrame:
        """SET; with ``source``, UPDATE ... FROM joined on the columns ``on`` (its others as ``source.c``).  The new rows return.

        Of several matches of a row the least counts, so a row stays one row.  ``conflict`` on keys as with ``insert``; fail
        counts as abort.
        """
        t = self.tables[name]
        df = t.df
        hit = _matches(where)
        if source is not None:
            rest = [c for c in source.columns if c not in on]
            one = source.where(_all_set(on)).groupBy(*on).agg(F.min(F.struct(*(rest or on))).alias("source"))
            df = df.join(one, on, "left")
            hit = hit & F.col("source").isNotNull()
        df = df.alias(name.split(".")[-1])
        new = F.struct(*[F.expr(e).cast(t.df.schema[c].dataType).alias(c) for c, e in values.items()])
        return self.update_marked(name, df.select(*t.df.columns, hit.alias("__hit"), new.alias("__new")), conflict)

    def update_marked(self, name: str, marked: DataFrame, conflict: str = "abort") -> DataFrame:
        """Rows of the table with ``__hit`` and ``__new``, a struct of the columns to set."""
        t = self.tables[name]
        columns = marked.schema["__new"].dataType.names
        if not self.authorize("update", name, *columns):
            return t.df.where("false")
        if computed := [c for c in columns if c in t.generated]:
            raise ValueError(f"cannot update generated column {computed[0]}")
        if conflict in ("ignore", "replace"):
            marked, gone = self._yield_keys(t, marked, columns, conflict)
            marked = shared_table(marked, "marked")  # settles which rows yield, and keeps the plan small
            gone = gone if gone is None else shared_table(gone, "gone")
        with self._statement(conflict):
            if conflict == "replace" and gone is not None:
                lost = gone.select(F.struct(*t.df.columns).alias("old"), F.lit(None).alias("new"))
                self._change(name, marked.select(*t.df.columns), changes=lost)
            return self._update(name, t, marked, columns)

    def _yield_keys(self, t: Table, marked: DataFrame, columns: list[str], conflict: str) -> tuple[DataFrame, DataFrame | None]:
        """Rows that would take a key of another: ignored, or the others go (second result).

        A key counts as taken if any other row has it before the statement.
        """
        gone = None
        for key in t.keys(set(columns)):
            new = [(F.col(f"__new.{c}") if c in columns else F.col(c)).alias(c) for c in key]
            wanted = marked.where("__hit").select(*new).where(_all_set(key)).distinct().withColumn("__wanted", F.lit(True))
            taken = marked.where(_all_set(key)).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)]).distinct().withColumn("__taken", F.lit(True))
            if conflict == "replace":
                both = marked.join(wanted, list(key), "left")
                lost = F.col("__wanted").isNotNull() & ~F.col("__hit")
                away = both.where(lost).select(*t.df.columns)
                gone = away if gone is None else gone.unionByName(away)
                marked = both.where(~lost).select(*marked.columns)
            values = [F.when(F.col("__hit"), n) for n in new]
            nth = F.row_number().over(Window.partitionBy(*values, F.when(~F.col("__hit"), F.monotonically_increasing_id())).orderBy(F.xxhash64(*t.df.columns)))
            numbered = marked.withColumn("__nth", nth)
            if conflict == "replace":
                again = F.col("__hit") & (F.col("__nth") > 1)
                gone = gone.unionByName(numbered.where(again).select(*t.df.columns))
                marked = numbered.where(~again).drop("__nth")
            else:
                on = [n == F.col(f"__k{i}") for i, n in enumerate(new)]
                joined = numbered.join(taken, reduce(lambda a, b: a & b, on), "left")
                same = reduce(lambda a, b: a & b, [n.eqNullSafe(F.col(c)) for n, c in zip(new, key, strict=True)])
                stays = F.col("__hit") & (same | (F.col("__taken").isNull() & (F.col("__nth") == 1)))
                marked = joined.select(*t.df.columns, stays.alias("__hit"), "__new")
        return marked, gone

    def _update(self, name: str, t: Table, marked: DataFrame, columns: list[str], added: DataFrame | None = None) -> DataFrame:
        value = {c: F.when(F.col("__hit"), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns}
        out = marked.select(*[value.get(c, F.col(c)).alias(c) for c in t.df.columns], "__hit", F.struct(*t.df.columns).alias("__old"))
        out = self._generated(t, out)
        hits = out.where("__hit")
        changes = hits.select(F.col("__old").alias("old"), F.struct(*t.df.columns).alias("new"))
        changed, rest = hits.select(*t.df.columns), out.where("not __hit").select(*t.df.columns)
        if columns:
            self._fire("before", "update", name, changes, columns)
        if added is not None:
            inserted = added.select(F.lit(None).alias("old"), F.struct(*t.df.columns).alias("new"))
            self._fire("before", "insert", name, inserted)
        after = out.select(*t.df.columns)
        touched = changed if added is None else changed.unionByName(added)
        self._change(name, after if added is None else after.unionByName(added), touched=touched, rest=rest, columns=None if added is not None else {*columns, *t.generated}, changes=changes if columns else None, cost=1 if added is None else THRICE)
        self._count(touched)
        if columns:
            self._fire("after", "update", name, changes, columns)
        if added is not None:
            self._fire("after", "insert", name, inserted)
        return touched

    def delete(self, name: str, where: str | Column | None = None) -> DataFrame:
        """Rows for which ``where`` is true go, foreign keys of other tables react; the removed rows return."""
        t = self.tables[name]
        return self.delete_marked(name, t.df.select("*", _matches(where).alias("__hit")))

    def delete_marked(self, name: str, marked: DataFrame) -> DataFrame:
        t = self.tables[name]
        if not self.authorize("delete", name):
            return t.df.where("false")
        gone = marked.where("__hit").select(*t.df.columns)
        changes = gone.select(F.struct(*t.df.columns).alias("old"), F.lit(None).alias("new"))
        with self._statement("abort"):
            self._fire("before", "delete", name, changes)
            self._change(name, marked.where("not __hit").select(*t.df.columns), changes=changes)
            self._count(gone)
            self._fire("after", "delete", name, changes)
        return gone

    def _full(self, t: Table, rows: DataFrame) -> DataFrame:
        """``rows`` with all columns of the table, defaults where one lacks."""
        have = rows.select(*[(F.col(f.name) if f.name in rows.columns else _default(t.defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in t.df.schema.fields])
        return self._generated(t, have)

    def _generated(self, t: Table, df: DataFrame) -> DataFrame:
        for c, e in t.generated.items():
            df = df.withColumn(c, F.expr(e).cast(t.df.schema[c].dataType))
        return df

    def _statement(self, conflict: str):
        return _Statement(self, conflict)

    # -- transactions ---------------------------------------------------------------------

    def _state(self) -> tuple:
        return dict(self.tables), dict(self.views), list(self.triggers), dict(self.indexes)

    def _restore(self, state: tuple) -> None:
        tables, views, triggers, indexes = state
        self.tables, self.views, self.triggers, self.indexes = dict(tables), dict(views), list(triggers), dict(indexes)

    def begin(self) -> None:
        if any(n is None for n, _ in self.stack):
            raise ValueError("cannot start a transaction within a transaction")
        self.stack.append((None, self._state()))

    def commit(self) -> None:
        """Deferred foreign keys are looked at; if one is broken, the transaction goes on."""
        if not self.stack:
            raise ValueError("no transaction is active")
        if self.foreign_keys:
            late = [(n, t, fk) for n, t in self.tables.items() for fk in t.foreign if fk.deferred]
            self._raise([(f"FOREIGN KEY constraint failed: {n} -> {fk.parent}", self.orphans(t.df, fk)) for n, t, fk in late])
        self.stack.clear()
        for body in self.hooks["commit"]:
            body(self)

    def rollback(self, to: str | None = None) -> None:
        """The whole transaction, or to a savepoint, which stays."""
        if to is None:
            if not self.stack:
                raise ValueError("no transaction is active")
            self._restore(self.stack[0][1])
            self.stack.clear()
            for body in self.hooks["rollback"]:
                body(self)
            return
        at = self._savepoint(to)
        self._restore(self.stack[at][1])
        del self.stack[at + 1 :]

    def savepoint(self, name: str) -> None:
        self.stack.append((name, self._state()))

    def release(self, name: str) -> None:
        """The outermost savepoint outside BEGIN ends the transaction it opened."""
        at = self._savepoint(name)
        if at == 0:
            self.commit()
        else:
            del self.stack[at:]

    def _savepoint(self, name: str) -> int:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                return i
        raise ValueError(f"no such savepoint: {name}")

    # -- triggers, constraints --------------------------------------------------------------

    def trigger(self, name: str, when: str, event: str, table: str, body: Callable | str, columns: Iterable[str] = (), condition: str | None = None) -> None:
        """``body`` once a statement for all rows it changes, or SQL once for each of them: before, after or, on a view, instead of it.

        ``columns``: UPDATE OF.  ``condition``: WHEN, over ``new.c`` and ``old.c``.
        """
        if any(t.name == name for t in self.triggers):
            raise ValueError(f"trigger {name} already exists")
        if table not in self.tables and table not in self.views:
            raise ValueError(f"no such table: {table}")
        if (when == "instead of") != (table in self.views):
            raise ValueError("views have INSTEAD OF triggers, and tables have the others")
        self.triggers.append(Trigger(name, when, event, table, body, tuple(columns), condition))

    def drop_trigger(self, name: str, if_exists: bool = True) -> None:
        if not if_exists and all(t.name != name for t in self.triggers):
            raise ValueError(f"no such trigger: {name}")
        self.triggers = [t for t in self.triggers if t.name != name]

    def _fire(self, time: str, event: str, table: str, changes: DataFrame, columns: Iterable[str] = ()) -> None:
        for t in list(self.triggers):
            if (t.time, t.event, t.table) != (time, event, table) or (t.columns and not set(t.columns) & set(columns)):
                continue
            rows = changes.where(_matches(t.when)) if t.when else changes
            own = self._touched, self._n
            if isinstance(t.body, str):
                from quern.engine import run_body

                run_body(self, t.body, rows)
            elif not rows.isEmpty():
                t.body(self, rows) if len(inspect.signature(t.body).parameters) > 1 else t.body(self)
            self._touched, self._n = own
        if time == "after":
            for body in self.hooks["update"]:
                body(self, table)

    def _instead(self, event: str, view: str, changes: DataFrame, columns: Iterable[str] = ()) -> None:
        if not any((t.time, t.event, t.table) == ("instead of", event, view) for t in self.triggers):
            raise ValueError(f"cannot modify {view} because it is a view")
        with self._statement("abort"):
            self._fire("instead of", event, view, changes, columns)

    def _count(self, touched: DataFrame) -> None:
        self._touched, self._n = touched, None
        self._uncounted.append(touched)

    @property
    def changes(self) -> int:
        """Rows that the last statement itself inserted, updated or deleted; counted when asked for."""
        if self._n is None:
            self._n = self._touched.count()
        return self._n

    @property
    def total_changes(self) -> int:
        """Rows of all statements, those of triggers too; what is not counted yet is counted in one job."""
        if self._uncounted:
            counts = [df.agg(F.count("*").alias("n")) for df in self._uncounted]
            self._counted += reduce(DataFrame.unionAll, counts).agg(F.sum("n")).first()[0]
            self._uncounted.clear()
        return self._counted

    def _change(self, name: str, df: DataFrame, *, touched: DataFrame | None = None, rest: DataFrame | None = None, columns: set[str] | None = None, changes: DataFrame | None = None, depth: int = 0, cost: int = 1) -> None:
        """The table's next snapshot: what is touched is checked, and other tables react to ``changes`` (old, new) of its rows."""
        t = self.tables[name]
        if t.age + cost >= CUT:
            t = replace(t, df=shared_table(df, "snapshot"), age=-cost)
        else:
            t = replace(t, df=df)
        self.tables[name] = replace(t, age=t.age + cost)
        if touched is not None:
            self._check(name, touched, rest, columns)
        if changes is not None and self.foreign_keys:
            self._react(name, changes, columns, depth)

    def _row_good(self, t: Table) -> Column:
        tests = [F.col(c).isNotNull() for c in dict.fromkeys((*t.primary, *t.not_null))] + [F.coalesce(F.expr(c), F.lit(True)) for c in t.checks]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def _violations(self, name: str, touched: DataFrame, rest: DataFrame | None, columns: set[str] | None) -> list[tuple[str, DataFrame]]:
        """What may be broken, and the rows that break it: touched rows, their keys among each other and in the ``rest``."""
        t, out = self.tables[name], []
        for c in dict.fromkeys((*t.primary, *t.not_null)):
            if columns is None or c in columns:
                out.append((f"NOT NULL constraint failed: {name}.{c}", touched.where(F.col(c).isNull())))
        out += [(f"CHECK constraint failed: {check}", touched.where(~F.coalesce(F.expr(check), F.lit(True)))) for check in t.checks]
        for key in t.keys(columns):
            known = touched.where(_all_set(key)).select(*key)
            what = f"UNIQUE constraint failed: {name}.{', '.join(key)}"
            out.append((what, known.groupBy(*key).count().where("count > 1")))
            if rest is not None:
                out.append((what, rest.where(_all_set(key)).select(*key).join(known, list(key), "left_semi")))
        if self.foreign_keys:
            for fk in t.foreign:
                if (columns is None or columns & set(fk.columns)) and not (fk.deferred and self.stack):
                    out.append((f"FOREIGN KEY constraint failed: {name} -> {fk.parent}", self.orphans(touched, fk)))
        return out

    def _check(self, name: str, touched: DataFrame, rest: DataFrame | None, columns: set[str] | None = None) -> None:
        self._raise(self._violations(name, touched, rest, columns))

    def _raise(self, violations: list[tuple[str, DataFrame]]) -> None:
        """One job for all constraints; the first that is broken is told."""
        if violations:
            found = reduce(DataFrame.unionAll, [df.select(F.lit(i).alias("what")).limit(1) for i, (_, df) in enumerate(violations)])
            first = found.agg(F.min("what")).first()[0]
            if first is not None:
                raise ConstraintError(violations[first][0])

    def broken(self) -> DataFrame:
        """(problem) of all constraints over whole tables."""
        found = [(what, df) for n, t in self.tables.items() for what, df in self._violations(n, t.df, None, None) if not what.startswith("FOREIGN")]
        parts = [df.select(F.lit(what).alias("problem")).limit(1) for what, df in found]
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], "problem string")

    def orphans(self, rows: DataFrame, fk: ForeignKey) -> DataFrame:
        """Rows whose foreign key has no null and no parent."""
        if fk.parent not in self.tables:
            raise ConstraintError(f"foreign key mismatch: no such table: {fk.parent}")
        parent = self.tables[fk.parent].df.select(*[F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns, strict=True)])
        return rows.where(_all_set(fk.columns)).join(parent, list(fk.columns), "left_anti")

    def _react(self, parent: str, changes: DataFrame, columns: set[str] | None, depth: int) -> None:
        if depth > 50:
            raise ConstraintError("foreign key actions are nested too deeply")
        ends = changes.schema["new"].dataType.typeName() == "void"
        for name in list(self.tables):
            for fk in self.tables[name].foreign:
                if fk.parent != parent or (not ends and columns is not None and not columns & set(fk.parent_columns)):
                    continue
                self._react_one(name, fk, changes, ends, depth)

    def _react_one(self, name: str, fk: ForeignKey, changes: DataFrame, ends: bool, depth: int) -> None:
        t = self.tables[name]
        action = fk.on_delete if ends else fk.on_update
        pairs = list(zip(fk.columns, fk.parent_columns, strict=True))
        keys = changes.select(*[F.col(f"old.{p}").alias(c) for c, p in pairs], *([] if ends else [F.col(f"new.{p}").alias(f"__new_{c}") for c, p in pairs])).where(_all_set(fk.columns))
        if not ends:
            moved = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__new_{c}")) for c in fk.columns])
            keys = keys.where(moved)
        keys = keys.dropDuplicates(list(fk.columns)).withColumn("__gone", F.lit(True))
        marked = t.df.join(keys, list(fk.columns), "left").withColumn("__hit", F.col("__gone").isNotNull())
        failed = ConstraintError(f"FOREIGN KEY constraint failed: {name} -> {fk.parent}")
        if action == "no action":
            if not (fk.deferred and self.stack) and not self.orphans(marked.where("__hit").select(*t.df.columns), fk).isEmpty():
                raise failed
            return
        if marked.where("__hit").isEmpty():
            return
        if action == "restrict":
            raise failed
        old = F.struct(*t.df.columns).alias("old")
        if action == "cascade" and ends:
            lost = marked.where("__hit").select(old, F.lit(None).alias("new"))
            self._change(name, marked.where("not __hit").select(*t.df.columns), changes=lost, depth=depth + 1)
            return
        kind = t.df.schema
        value = {
            "cascade": lambda c: F.col(f"__new_{c}"),
            "set null": lambda c: F.lit(None),
            "set default": lambda c: _default(t.defaults.get(c)),
        }[action]
        out = marked.select(*[F.when(F.col("__hit"), value(c).cast(kind[c].dataType)).otherwise(F.col(c)).alias(c) if c in fk.columns else F.col(c) for c in t.df.columns], "__hit", old.alias("__old"))
        out = self._generated(t, out)
        hits = out.where("__hit")
        after = hits.select(F.col("__old").alias("old"), F.struct(*t.df.columns).alias("new"))
        self._change(name, out.select(*t.df.columns), touched=hits.select(*t.df.columns), rest=out.where("not __hit").select(*t.df.columns), columns={*fk.columns, *t.generated}, changes=after, depth=depth + 1)

    # -- copies -----------------------------------------------------------------------------

    def backup(self, path: str) -> None:
        """Every table as Parquet under ``path``."""
        for name, t in self.tables.items():
            write(t.df, f"{path}/{name}")

    def attach(self, schema: str, path: str, names: list[str]) -> None:
        """Tables of another store's backup, as ``schema.name``."""
        for name in names:
            self.tables[f"{schema}.{name}"] = Table(self.spark.read.parquet(f"{path}/{name}"))

    def detach(self, schema: str) -> None:
        self.tables = {n: t for n, t in self.tables.items() if not n.startswith(schema + ".")}


class _Statement:
    """All of a statement or nothing of it; with rollback, nothing of the transaction."""

    def __init__(self, store: Store, conflict: str):
        self.store, self.conflict, self.before = store, conflict, store._state()

    def __enter__(self):
        return self

    def __exit__(self, kind, error, trace):
        if kind is not None:
            self.store._restore(self.before)
            if self.conflict == "rollback" and issubclass(kind, ConstraintError) and self.store.stack:
                self.store.rollback()
        return False


def _default(value) -> Column:
    return F.expr(value.text) if isinstance(value, Expr) else F.lit(value)


#: Functions that every new store is given to, to register what they bring.
AUTO_EXTENSIONS: list[Callable[[Store], None]] = []
EXTENSIONS: dict[str, Callable[[Store], None]] = {}


def register_extension(name: str, init: Callable[[Store], None], auto: bool = False) -> None:
    """``init(store)`` on ``load_extension(store, name)``, or with ``auto`` for each new store."""
    EXTENSIONS[name] = init
    if auto:
        AUTO_EXTENSIONS.append(init)


def load_extension(store: Store, name: str) -> None:
    if name not in EXTENSIONS:
        raise ValueError(f"no such extension: {name}")
    EXTENSIONS[name](store)
