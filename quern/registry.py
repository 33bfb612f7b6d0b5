"""Registry that keeps each operator's Spark query and its oracle SQL side by side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.tables import run_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def operator(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``key`` with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"operator {key} is registered twice")
        QUERIES[key] = f
        if oracle is not None:
            ORACLE[key] = oracle
        return f

    return add


def sql_operator(key: str, text: str, oracle: str | None = None) -> None:
    """Register Spark SQL (tables in braces); without ``oracle`` the same text is the oracle's."""
    operator(key, oracle or re.sub(r"\{(\w+)\}", r"\1", text))(lambda spark, sf_dir: run_sql(spark, sf_dir, text))
