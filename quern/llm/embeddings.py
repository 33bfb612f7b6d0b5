"""Embedding near-duplicates by int8 tile products with rigorous error bounds (operator 10).

Within a label every pair of distinct vectors is compared once, in tiles of two blocks.  A tile normalises its vectors,
quantises each to int8 with its own scale, and multiplies the codes (exact integers).  With e the distance of a unit
vector from its quantised image, the product of two images is off the cosine by at most e1 + (1 + e1) e2; only pairs
whose product plus that bound reaches the threshold are computed again in double precision, and that decides.

Scale: copies are one row before the tiles (with a count), so a common vector costs nothing.  A row goes to as many
tiles as its label has blocks; no task holds more than two blocks, whatever the size of a label.  A tile returns a
count a row and a spanning forest of its links, never its pairs.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without a label, link with
nothing; vectors of different length never link; repeated rows with one id count as a row each, be their vectors equal or not, and each has
the links of its own vector; components of any finite size are compared (vectors are scaled by powers of two); a null id takes
no part; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import connected_components, free_names
from quern.shared import drop_table, shared_table

THRESHOLD, BLOCK = 0.93, 2048
#: Covers what double and float arithmetic may add to the bound.
SLACK = 1e-6


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit vectors -> int8 codes, scale and distance of each row from its image."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows; float32 holds those of 1000 components, the sums are in doubles."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1000):
        out += a[:, at : at + 1000].astype(np.float32) @ b[:, at : at + 1000].astype(np.float32).T
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between 1/2 and 1: squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def tile(a: np.ndarray, b: np.ndarray | None, threshold: float) -> list[tuple[int, np.ndarray]]:
    """Row numbers of ``a`` and those of ``b`` linked to each (``b`` None: later rows of ``a`` itself)."""
    same = b is None
    a = scaled(a)
    b = a if same else scaled(b)
    norm_a = np.sqrt((a**2).sum(axis=1))
    norm_b = norm_a if same else np.sqrt((b**2).sum(axis=1))
    qa, sa, ea = quantised(a / norm_a[:, None])
    qb, sb, eb = quantised(b / norm_b[:, None])
    out = []
    for at in range(0, len(a), 256):
        rows = slice(at, at + 256)
        near = products(qa[rows], qb) * sa[rows, None] * sb + ea[rows, None] + (1 + ea[rows, None]) * eb >= threshold - SLACK
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            j = np.flatnonzero(near[i])
            i += at
            if same:
                j = j[j > i]
            j = j[(b[j] * a[i]).sum(axis=1) / (norm_a[i] * norm_b[j]) >= threshold]
            if len(j):
                out.append((i, j))
    return out


def _compared(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf["block"] == pdf["i"]
        a = pdf[left]
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        b = a if same else pdf[~left]
        empty = pd.DataFrame({"u": [], "v": [], "n": []}, dtype="int64")
        if not len(a) or not len(b):
            return empty
        ids = np.concatenate((a["id"], [] if same else b["id"])).astype(np.int64)
        copies = np.concatenate((a["copies"], [] if same else b["copies"])).astype(np.int64)
        shift = 0 if same else len(a)
        matrix = lambda x: np.array(x["v"].tolist(), np.float64)
        counts, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, js in tile(matrix(a), None if same else matrix(b), threshold):
            js = js + shift
            counts[i] += copies[js].sum()
            counts[js] += copies[i]
            joined = np.unique(root[np.append(js, i)])
            if len(joined) > 1:
                root[np.isin(root, joined[1:])] = joined[0]
        linked, child = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"u": np.concatenate((ids[linked], ids[child])), "v": np.concatenate((ids[linked], ids[root[child]])), "n": np.concatenate((counts[linked], np.zeros(len(child), np.int64)))})

    return run


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``n_links`` and ``component`` of every row (with an underscore behind them if the key has that name)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    part = F.coalesce(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & good, F.lit(False))
    rows = shared_table(rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.when(part, v).alias("v")), "vectors")
    distinct = rows.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    # distinct vectors are numbered, as two of them may have rows of one id
    distinct = shared_table(distinct.withColumns({"dims": F.size("v"), "rep": F.monotonically_increasing_id()}), "distinct")
    sizes = distinct.groupBy("label", "dims").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = distinct.join(sizes, ["label", "dims"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dims", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("rep").alias("id"), "copies", "v"
    )
    found = shared_table(tiles.groupBy("label", "dims", "i", "j").applyInPandas(_compared(threshold), "u long, v long, n long"), "links")
    counts = found.where("u = v").groupBy("u").agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("u <> v").select("u", "v"))
    reps = distinct.join(counts, F.col("rep") == F.col("u"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    reps = reps.select("label", "v", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    named = reps.groupBy("component").agg(F.min("least").alias("name"))
    reps = shared_table(reps.join(named, "component").select("label", "v", "n_links", "name"), "classes")
    for df in (distinct, found, comp):
        drop_table(df)
    n_links, component = free_names([key], "n_links", "component")
    linked = rows.where("v is not null").join(reps, ["label", "v"]).select("id", "n_links", "name")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("name"))
    return linked.unionByName(alone).select(F.col("id").alias(key), F.col("n_links").alias(n_links), F.col("name").alias(component))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_duplicates(rows).select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


SQL = """WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
c(u, w) AS (SELECT vec_id, vec_id FROM e UNION SELECT c.u, l.w FROM c JOIN l ON c.w = l.u)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.u = e.vec_id) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM e JOIN (SELECT u, min(w) AS component_id FROM c GROUP BY u) m ON m.u = e.vec_id"""
