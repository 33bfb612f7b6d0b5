"""User functions by name and number of arguments: scalars, aggregates of a step and a final function, and table functions.

A call in SQL names the function alone; ``resolve`` finds the one for the number of arguments (an exact match before one
that takes any number), as Spark has one function a name.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quern.dialect import meaningful


@dataclass(frozen=True)
class Aggregate:
    """``step(state, *values)`` gives the next state, ``merge(a, b)`` that of two parts of a group, ``finalize(state)`` the result.

    States are pickled between tasks, so partial states, not rows, are shuffled.
    """

    initial: Callable[[], Any]
    step: Callable
    merge: Callable[[Any, Any], Any]
    finalize: Callable[[Any], Any]
    kind: str  # the Spark type of the result


class Functions:
    """Functions of one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.scalars: dict[str, dict[int, str]] = {}
        self.aggregates: dict[str, Aggregate] = {}

    def scalar(self, name: str, f: Callable[..., pd.Series], kind: str, arguments: int = -1) -> None:
        """A vectorised function (pandas series in and out, in Arrow batches) for that many arguments; -1 takes any number."""
        registered = f"{name}__{'n' if arguments < 0 else arguments}"
        self.spark.udf.register(registered, F.pandas_udf(_typed(f, arguments), kind))
        self.scalars.setdefault(name.lower(), {})[arguments] = registered

    def aggregate(self, name: str, made: Aggregate) -> None:
        self.aggregates[name.lower()] = made

    def table(self, name: str, handler: type, returns: str) -> None:
        """A table function: a class whose ``eval`` yields rows."""
        self.spark.udtf.register(name, F.udtf(handler, returnType=returns))

    def lookup(self, name: str, arguments: int) -> str:
        known = self.scalars.get(name.lower(), {})
        if arguments in known:
            return known[arguments]
        if -1 in known:
            return known[-1]
        raise LookupError(f"no function {name} takes {arguments} arguments")

    def resolve(self, text: str) -> str:
        """SQL with the calls of overloaded functions replaced by those of the functions that fit."""
        parts = meaningful(text)
        out = []
        for k, t in enumerate(parts):
            if t.lower() in self.scalars and k + 1 < len(parts) and parts[k + 1] == "(":
                out.append(self.lookup(t, _arguments(parts, k + 1)))
            else:
                out.append(t)
        return " ".join(out)

    def grouped(self, df: DataFrame, by: list[str], **calls: tuple) -> DataFrame:
        """``by`` and result = (aggregate's name, *columns) for each group; without ``by`` one row, as in SQL."""
        return fold(df, by, {out: (self.aggregates[name.lower()], columns) for out, (name, *columns) in calls.items()})


def _typed(f: Callable, arguments: int) -> Callable:
    """``f`` with the annotations that tell Spark how it is called."""
    if arguments < 0:

        def any_number(*values: pd.Series) -> pd.Series:
            return f(*values)

        return any_number
    names = ", ".join(f"a{k}: pd.Series" for k in range(arguments))
    space: dict[str, Any] = {"pd": pd, "f": f}
    exec(f"def call({names}) -> pd.Series:\n    return f({', '.join(f'a{k}' for k in range(arguments))})", space)  # noqa: S102
    return space["call"]


def _arguments(parts: list[str], at: int) -> int:
    depth, n = 0, 0
    for k in range(at, len(parts)):
        depth += (parts[k] == "(") - (parts[k] == ")")
        if depth == 0:
            return 0 if k == at + 1 else n + 1
        n += parts[k] == "," and depth == 1
    raise ValueError("a bracket is not closed")


def fold(df: DataFrame, by: list[str], calls: dict[str, tuple[Aggregate, list[str | Column]]]) -> DataFrame:
    """Aggregates in two steps: each task folds its rows to a state a group, and the states of a group are merged."""
    made = [a for a, _ in calls.values()]
    arguments = [c if isinstance(c, Column) else F.col(c) for _, columns in calls.values() for c in columns]
    keys, values = [f"k{i}" for i in range(len(by))], [f"v{i}" for i in range(len(arguments))]
    ends = [sum(len(c) for _, c in list(calls.values())[:i]) for i in range(len(made) + 1)]
    keyed = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], *[c.alias(v) for c, v in zip(arguments, values, strict=True)], F.lit(1).alias("one"))
    kinds = ", ".join(f"{k} {df.schema[c].dataType.simpleString()}" for k, c in zip(keys, by, strict=True))

    def partial(batches):
        states: dict[tuple, list] = {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            for row in zip(*columns, strict=True) if columns else [()] * batch.num_rows:
                key = row[: len(keys)]
                at = states.get(key)
                if at is None:
                    at = states[key] = [a.initial() for a in made]
                for i, a in enumerate(made):
                    at[i] = a.step(at[i], *row[len(keys) + ends[i] : len(keys) + ends[i + 1]])
            if len(states) > 100_000:  # what a task holds is bounded; a group may have several states
                yield states
                states = {}
        if states:
            yield states

    def run(batches):
        fields = [f.type for f in to_arrow_schema(keyed_schema)]
        for states in partial(batches):
            columns = [pa.array(c, t) for c, t in zip(zip(*states, strict=True), fields, strict=False)] if keys else []
            yield pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], names=[*keys, "state"])

    keyed_schema = keyed.schema
    states = keyed.mapInArrow(run, f"{kinds}, state binary" if keys else "state binary")
    if not keys:  # no rows are one group
        states = states.unionAll(df.sparkSession.createDataFrame([(pickle.dumps([a.initial() for a in made]),)], "state binary"))

    def merged(i: int, a: Aggregate):
        def total(states: pd.Series) -> float:
            whole, *rest = (pickle.loads(s)[i] for s in states)  # noqa: S301
            for s in rest:
                whole = a.merge(whole, s)
            return a.finalize(whole)

        return F.pandas_udf(total, a.kind)("state")

    out = states.groupBy(*keys).agg(*[merged(i, a).alias(f"r{i}") for i, a in enumerate(made)])
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *[F.col(f"r{i}").alias(c) for i, c in enumerate(calls)])
