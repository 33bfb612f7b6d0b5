"""Exact top-k search by inner product with Fagin's threshold algorithm (operator 6).

Vectors are cut into blocks.  In a block every dimension has a list of the block's distinct vectors sorted by that
component.  A query walks all lists at once, best end first (by the sign of its own component), looks up in full
every vector it meets, and stops when the bound - the sum over dimensions of its component times the value reached
in that list - is below the k-th score so far: no vector not yet met can do better.  Ties at the bound are still
walked, so results are exact with ties to the smaller id.

Components are integers (floor of 1024 x; beyond 64 bits the nearest 64-bit integer), and so are scores: nothing is rounded.  A sum
beyond 64 bits counts as the nearest 64-bit integer.

Scale: block numbers come from hashing row numbers, so a common vector or id is spread evenly; copies inside a block are one list
entry that keeps its k + 1 smallest ids (no other copy can be among the k).  Query blocks meet candidate blocks as tiles
(a stated query set against all rows); a tile returns at most k rows a query, and a ranking window that prunes before its
shuffle merges them.  No task holds more than a block of each side.

Defined results: vectors that are null or hold null or non-finite components take no part, as query or candidate; vectors of
another length than a query's are compared on no dimension, so they take no part for it; a query without other rows has no
result; repeated ids are rows each; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.shared import shared_table


SCALE, K = 1024, 10
#: Candidates and queries in a block.
BLOCK, QUERY_BLOCK = 16_384, 2_048
#: Entries of each list that one step of the walk takes.
STEP = 64


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.k = k
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.vectors, group = np.unique(vectors, axis=0, return_inverse=True)
        self.largest = max(abs(int(vectors.min())), abs(int(vectors.max())))
        order = np.argsort(group.ravel(), kind="stable")  # by vector, then by id
        size = np.bincount(group.ravel(), minlength=len(self.vectors))
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        rank = np.arange(len(ids)) - np.repeat(start, size)
        keep = rank <= k  # k + 1 smallest ids, as the query's own may be among them
        self.ids = ids[order][keep]
        kept = np.minimum(size, k + 1)
        self.start = np.concatenate(([0], np.cumsum(kept)))
        self.up = np.argsort(self.vectors, axis=0, kind="stable")  # positions, smallest component first
        self.down = self.up[::-1]

    def search(self, own: int, query: np.ndarray) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but ``own``, best first."""
        n, dims = self.vectors.shape
        used, rises, falls = np.flatnonzero(query), np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        values = self.vectors
        if dims * int(self.largest) * max(abs(x) for x in query.tolist()) >= 1 << 63:  # a score may be beyond 64 bits: Python's integers
            values, query = values.astype(object), query.astype(object)
        seen = np.zeros(n, bool)
        scores = np.empty(0, values.dtype)
        groups = np.empty(0, np.int64)
        at, step = 0, STEP
        while at < n:
            to = min(n, at + step)
            if len(used):
                met = np.zeros(n, bool)
                met[self.down[at:to, rises]] = True
                met[self.up[at:to, falls]] = True
                rows = np.flatnonzero(met & ~seen)
                seen |= met
            else:
                rows, to = np.arange(n), n  # every score is zero: all are met
            found = values[rows] @ query
            scores = np.concatenate((scores, found if found.dtype == np.int64 else np.clip(found, -(1 << 63), (1 << 63) - 1)))
            groups = np.concatenate((groups, rows))
            if len(scores) > 2 * self.k + 2:  # keep what may still be among the k: at least k + 1 groups, and ties
                least = np.sort(scores)[len(scores) - self.k - 1]
                keep = scores >= least
                scores, groups = scores[keep], groups[keep]
            at, step = to, step * 2
            if at < n:
                reached = [(d, self.down[at - 1, d]) for d in rises] + [(d, self.up[at - 1, d]) for d in falls]
                bound = sum(int(query[d]) * int(self.vectors[row, d]) for d, row in reached)
                best = self._rows(scores, groups, own)
                if len(best) == self.k and best[-1][0] > bound:
                    return best
        return self._rows(scores, groups, own)

    def _rows(self, scores, groups, own) -> list[tuple[int, int]]:
        out, ids, start = [], self.ids, self.start
        for s in sorted(set(scores.tolist()), reverse=True):
            near = np.sort(np.concatenate([ids[start[g] : start[g + 1]] for g in groups[scores == s].tolist()]))
            out += [(int(s), int(i)) for i in near[: self.k + 1] if i != own]
            if len(out) >= self.k:
                break
        return out[: self.k]


def integers(vector):
    """floor(SCALE * x) of every component as longs; null where a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * SCALE)))


def top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = K) -> DataFrame:
    """(key, vector as array<long>) twice -> query_id, rank, vec_id, score: each query's k best other rows."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        df = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("v is not null and id is not null")
        return shared_table(df.withColumn("n", F.monotonically_increasing_id()), name)

    rows, queries = numbered(rows, "vectors"), numbered(queries, "queries")
    blocks = max(1, -(-rows.count() // BLOCK))
    sets = max(1, -(-queries.count() // QUERY_BLOCK))
    # a tile is a candidate block and a query set; each side is repeated for the blocks of the other
    tile = lambda b, q: b * F.lit(sets) + q
    left = rows.select("id", "v", "n", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("q")).select(tile(F.pmod(F.xxhash64("n"), F.lit(blocks)), F.col("q")).alias("tile"), "id", "v")
    right = queries.select("id", "v", "n", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")).select(tile(F.col("b"), F.pmod(F.xxhash64("n", F.lit(1)), F.lit(sets))).alias("tile"), "id", "v")

    def search(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        for dims, part in mine.groupby(mine["v"].map(len)):
            wanted = asked[asked["v"].map(len) == dims]
            if not len(wanted) or not dims:
                continue
            lists = Lists(part["id"].to_numpy(np.int64), np.array(part["v"].tolist(), np.int64), k)
            for own, query in zip(wanted["id"].tolist(), wanted["v"], strict=True):
                for score, other in lists.search(own, np.array(query, np.int64)):
                    out["query_id"].append(own)
                    out["vec_id"].append(other)
                    out["score"].append(score)
        return pd.DataFrame(out, dtype="int64")

    found = left.groupBy("tile").cogroup(right.groupBy("tile")).applyInPandas(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", integers(F.col("embedding")).alias("v"))
    return top_k(rows.where("vec_id % 100 = 0"), rows, "vec_id", "v")


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
