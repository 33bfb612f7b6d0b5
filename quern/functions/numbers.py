"""Numeric and generic scalar functions of the dialect, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, FractionalType, IntegralType, NullType


def any_null(*args: Column) -> Column:
    out = args[0].isNull()
    for a in args[1:]:
        out = out | a.isNull()
    return out


def least(*args: Column) -> Column:
    """Scalar min: null if any argument is null."""
    return F.when(~any_null(*args), F.least(*args))


def greatest(*args: Column) -> Column:
    return F.when(~any_null(*args), F.greatest(*args))


def divide(a: Column, b: Column) -> Column:
    """Integer division truncates, division by zero is null."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def modulo(a: Column, b: Column) -> Column:
    return a % F.nullif(b, F.lit(0))


def absolute(c: Column) -> Column:
    """Null for the least integer, which has no positive."""
    return F.when(c != F.lit(-(2**63)), F.abs(c))


def rounded(c: Column, digits: int = 0) -> Column:
    """Half away from zero, always a double, digits within 0 and 30."""
    return F.round(c.cast("double"), max(0, min(30, digits)))


def total(c: Column) -> Column:
    """sum as a double, 0.0 over no rows."""
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


def safe_sum(c: Column) -> Column:
    """Integer sum; null where it overflows."""
    return F.try_sum(c.cast("bigint"))


def type_of(c: Column, kind: DataType) -> Column:
    """null, integer, real, text or blob."""
    name = "null" if isinstance(kind, NullType) else "integer" if isinstance(kind, (IntegralType, BooleanType)) else "real" if isinstance(kind, FractionalType) else "blob" if isinstance(kind, BinaryType) else "text"
    return F.when(c.isNull(), "null").otherwise(F.lit(name))


def numeric_prefix(text: Column) -> Column:
    """The number that a text begins with, as a double; 0 if none."""
    found = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(found.try_cast("double"), F.when(text.isNotNull(), F.lit(0.0)))


def integer_prefix(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.when(text.isNotNull(), F.lit(0).cast("bigint")))
