"""Change capture: the difference of two snapshots by key as rows (op, key, old, new); apply and invert them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """op I, U or D, the keys, and the row before and after as structs of the other columns.  One full outer join."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("old"), F.lit(True).alias("__a"))
    b = new.select(*keys, F.struct(*rest).alias("new"), F.lit(True).alias("__b"))
    both = a.join(b, keys, "full")
    op = F.when(F.col("__a").isNull(), "I").when(F.col("__b").isNull(), "D").otherwise("U")
    return both.where(F.col("__a").isNull() | F.col("__b").isNull() | ~F.col("old").eqNullSafe(F.col("new"))).select(op.alias("op"), *keys, "old", "new")


def invert(changes: DataFrame) -> DataFrame:
    keys = [c for c in changes.columns if c not in ("op", "old", "new")]
    op = F.when(F.col("op") == "I", "D").when(F.col("op") == "D", "I").otherwise("U")
    return changes.select(op.alias("op"), *keys, F.col("new").alias("old"), F.col("old").alias("new"))


def apply(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the changes: rows that no change names, and the new rows."""
    kept = table.join(changes.select(*keys), keys, "left_anti")
    rest = [c for c in table.columns if c not in keys]
    made = changes.where("op <> 'D'").select(*[F.col(c) if c in keys else F.col(f"new.{c}") for c in [*keys, *rest]])
    return kept.select(*table.columns).unionByName(made.select(*table.columns))


def conflicts(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes whose old row is not what the table holds."""
    rest = [c for c in table.columns if c not in keys]
    now = table.select(*keys, F.struct(*rest).alias("__now"))
    joined = changes.join(now, keys, "left")
    bad = reduce(lambda a, b: a | b, [(F.col("op") == "I") & F.col("__now").isNotNull(), (F.col("op") != "I") & ~F.col("old").eqNullSafe(F.col("__now"))])
    return joined.where(bad).drop("__now")


def encode(changes: DataFrame) -> DataFrame:
    """(payload binary): a changeset that can be stored or sent, a row a change."""
    return changes.select(F.encode(F.to_json(F.struct(*changes.columns), {"ignoreNullFields": "false"}), "utf-8").alias("payload"))


def decode(payloads: DataFrame, schema: StructType) -> DataFrame:
    """The changes of a changeset; ``schema`` is that of the changes."""
    return payloads.select(F.from_json(F.decode("payload", "utf-8"), schema, {"mode": "FAILFAST"}).alias("c")).select("c.*")
