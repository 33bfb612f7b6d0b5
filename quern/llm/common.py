"""Pieces shared by the training-data operators: components, letters, names that are free."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.shared import drop_table, shared_table

#: Tasks that the links of one node are dealt to.
SALTS = 16
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def tidied(run):
    """A map over Arrow batches that gives its memory back to the system when it ends, as idle workers stay with their executor."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return inner


@tidied
def _forest(batches):
    """Edges of one partition -> a star forest with the same components (union-find)."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                if a < b:
                    a, b = b, a
                parent[a] = b
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        some = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], names=["u", "v"])


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores behind it as it takes to differ from ``columns``, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _with_least(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` (u, v) joined with ``low`` (u, m): a hub's edges are dealt to ``SALTS`` tasks, each with its row of ``low``."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    each = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each.hint("merge"), ["u", "salt"])  # never broadcast: ``low`` grows with the links


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) -> (node, component) with component the smallest node reachable.

    Alternating large-star and small-star rounds, each written to the shared folder; the driver sees
    only a row count and a checksum a round.  Each partition first contracts its own edges to a star
    forest.  Every node of an edge between two nodes is returned, the component's smallest too; a node without such an
    edge is not.  Null ends are ignored.  A hub's links are salted, as it may be linked with a third of all nodes.
    """
    cur = shared_table(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .mapInArrow(_forest, "u long, v long")
        .distinct(),
        "edges",
    )
    before = None
    while True:
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        new = shared_table(small.where("u <> v").distinct(), "edges")
        drop_table(cur)
        cur = new
    # stars by now: leaves name their centre, and centres name themselves
    named = cur.unionAll(cur.select(F.col("v").alias("u"), "v"))
    out = named.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    out._quern_path = cur._quern_path  # for drop_table
    return out
