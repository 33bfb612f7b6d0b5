"""All registered operators; importing the modules registers them."""

from __future__ import annotations

from quern.operators import aggregates, changes, joins, predicates, scalars, scans, sets, sorts, statements, windows  # noqa: F401
from quern.plans import flagship  # noqa: F401
from quern.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
