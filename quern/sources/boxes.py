"""N-dimensional boxes (``x0, x1, y0, y1, ...``): overlap predicate and an overlap join on grids of several cell sizes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(window: dict[str, tuple[float, float]]) -> Column:
    """Boxes that touch the window; range predicates that reach a Parquet scan."""
    tests = [(F.col(f"{d}1") >= low) & (F.col(f"{d}0") <= high) for d, (low, high) in window.items()]
    return reduce(lambda a, b: a & b, tests)


#: Boxes of a block of a cell, pairs that a task compares, rows that it reads, and crowded cells that are broadcast.
BLOCK, PAIRS, ROWS, LISTED = 2048, 1 << 24, 1 << 20, 1 << 18


def overlap_join(boxes: DataFrame, cell: dict[str, float]) -> DataFrame:
    """Pairs (a_id < b_id) of boxes that touch: an equi-join on grid cells, verified.

    A box lives on the finest grid (``cell`` times a power of two) whose cells it is no wider than, so on at most two cells a
    dimension however wide it is (three where its width was rounded).  A pair meets on the coarser grid of its two boxes: every box is looked up on its own grid and on
    the coarser ones that exist (the driver reads their numbers, a few dozen at most).  A pair is reported in the cell that holds the
    lower corner of its intersection alone, so nothing is deduplicated.  Boxes with a null or NaN corner touch nothing.

    Pairs of a crowded cell grow with the square of its boxes.  Such a cell is cut into blocks of ``BLOCK`` boxes by a hash, every
    pair of blocks is a key of its own, and there are as many tasks as the pairs to compare need: one task's work stays the same
    however many boxes there are or share a cell.
    """
    dims = list(cell)
    corners = [f"{d}{i}" for d in dims for i in (0, 1)]
    rows = boxes.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in corners]))
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(f"{d}0") <= F.col(f"{d}1") for d in dims]))
    width = F.greatest(*[(F.col(f"{d}1") - F.col(f"{d}0")) / cell[d] for d in dims], F.lit(1.0))
    rows = rows.select("id", *[F.col(c).cast("double").alias(c) for c in corners], F.ceil(F.log2(width)).cast("int").alias("own"))
    levels = sorted(r[0] for r in rows.select("own").distinct().collect())  # at most as many as a double has exponents

    def on_grid(df: DataFrame) -> DataFrame:
        for d, size in cell.items():
            low, high = (F.floor(F.col(f"{d}{i}") / (F.lit(size) * F.pow(F.lit(2.0), "level"))) for i in (0, 1))
            df = df.withColumn(f"low_{d}", low).withColumn(f"cell_{d}", F.explode(F.when(low == high, F.array(low)).otherwise(F.sequence(low, high))))
            df = df.withColumn(f"low_{d}", F.col(f"low_{d}") == F.col(f"cell_{d}"))
        return df

    cells = ["level", *[f"cell_{d}" for d in dims]]
    coarser = F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("own"))) if levels else F.col("own")
    at_home = F.col("own") == F.col("level")
    sizes = on_grid(rows.withColumn("level", coarser)).groupBy(cells).agg(F.count_if(at_home).alias("n_home"), F.count_if(~at_home).alias("n_finer"))
    full = F.greatest("n_home", "n_finer") > BLOCK
    blocks = {f"{x}_blocks": F.greatest(F.ceil(F.col(f"n_{x}") / BLOCK), F.lit(1)).cast("int") for x in ("home", "finer")}
    pairs = F.col("n_home") * (F.col("n_home") / 2 + F.col("n_finer"))
    copies = (F.col("n_home") + F.col("n_finer")) * (blocks["home_blocks"] + blocks["finer_blocks"])
    n_pairs, n_rows, n_full = sizes.agg(F.sum(pairs), F.sum(copies.cast("double")), F.count_if(full)).first()
    tasks = math.ceil(max((n_pairs or 0) / PAIRS, (n_rows or 0) / ROWS))

    if n_full:
        rows = rows.repartition(max(tasks, 1), "id")  # copied below, once for each block of their cells
    a, b, keys = on_grid(rows.withColumn("level", coarser)), on_grid(rows.withColumn("level", F.col("own"))), cells
    same_block = F.lit(True)
    if n_full:
        crowded = sizes.where(full).select(*cells, *[x.alias(name) for name, x in blocks.items()])
        crowded = F.broadcast(crowded) if n_full <= LISTED else crowded

        def dealt(df: DataFrame) -> DataFrame:
            df = df.join(crowded, cells, "left").withColumns({x: F.coalesce(x, F.lit(1)) for x in blocks})
            own_blocks = F.when(at_home, F.col("home_blocks")).otherwise(F.col("finer_blocks"))
            return df.withColumn("block", F.pmod(F.xxhash64("id", *corners), own_blocks).cast("int"))

        # a home box meets its own block of home boxes and those behind it, a finer box all of them
        a = dealt(a).withColumns({"block_a": F.col("block"), "block_b": F.explode(F.sequence(F.when(at_home, F.col("block")).otherwise(0), F.col("home_blocks") - 1))})
        b = dealt(b).withColumns({"block_b": F.col("block"), "block_a": F.explode(F.sequence(F.lit(0), F.greatest("block", F.col("finer_blocks") - 1)))})
        keys, same_block = [*cells, "block_a", "block_b"], F.col("block_a") == F.col("block_b")
    a, b = (df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in ("id", "own", *corners, *[f"low_{d}" for d in dims])]) for side, df in (("a", a), ("b", b)))
    if tasks > 1:  # adaptive execution would merge partitions of few bytes, whatever their pairs
        a, b = (df.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), *keys) for df in (a, b))
    # merged, as a broadcast would leave all pairs to the tasks that scan the other side
    both = a.join(b.hint("merge"), keys).where(F.when((F.col("a_own") == F.col("level")) & same_block, F.col("a_id") < F.col("b_id")).otherwise(F.col("a_id") != F.col("b_id")))
    for d in dims:
        both = both.where((F.col(f"a_{d}0") <= F.col(f"b_{d}1")) & (F.col(f"a_{d}1") >= F.col(f"b_{d}0")))
        both = both.where(F.col(f"a_low_{d}") | F.col(f"b_low_{d}"))
    return both.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))
