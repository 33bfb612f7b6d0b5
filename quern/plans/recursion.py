"""Fixpoint of a recursive query beyond the level limit of WITH RECURSIVE."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from quern.shared import shared_table

#: Rounds between two cuts of the lineage.
CUT = 10


class RecursionLimitError(RuntimeError):
    """A fixpoint is not reached within the rounds allowed; nothing is returned."""


def fixpoint(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = False, limit: int | None = None) -> DataFrame:
    """Anchor, then ``step`` of the last round's rows until a round is empty.

    Each round is cached until the next cut, where what was found since the last one is written to the shared folder, so neither plans
    nor recomputation nor what is cached grow with the rounds; with ``distinct`` rows that were seen before end a branch.  Without
    ``limit`` rounds go on until one is empty; with it, an error tells if that many were not enough.
    """
    working = anchor.distinct() if distinct else anchor
    done, recent, n = [], [working], 0

    def cut():
        done.append(shared_table(reduce(DataFrame.unionAll, recent), "rounds"))
        for df in recent:
            df.unpersist()
        recent.clear()

    while True:
        following = step(working)
        if distinct:
            following = following.distinct().subtract(reduce(DataFrame.unionAll, [*done, *recent]))
        following = following.cache()
        if following.isEmpty():
            following.unpersist()
            break
        n += 1
        if limit is not None and n > limit:
            following.unpersist()
            for df in recent:
                df.unpersist()
            raise RecursionLimitError(f"rows are still found after {limit} rounds")
        recent.append(following)
        working = following
        if n % CUT == 0:
            working = shared_table(following, "round")
            cut()
    if recent:
        cut()
    return reduce(DataFrame.unionAll, done)
