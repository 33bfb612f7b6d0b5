"""Date and time functions of the dialect: modifiers, Julian days and a strftime compiler, as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

JULIAN_EPOCH = 2440587.5


def moment(value: Column, *modifiers: str) -> Column:
    """A timestamp with modifiers applied in turn; null for a modifier that is not known.

    ``±N unit`` for day, hour, minute, second, month, year (a month add stays within the month), ``start of
    day|month|year``; ``utc`` and ``localtime`` change nothing.
    """
    ts = value.cast("timestamp")
    for text in modifiers:
        m = re.fullmatch(r"\s*([+-]?\d+(?:\.\d+)?)\s+(day|hour|minute|second|month|year)s?\s*", text, re.I)
        start = re.fullmatch(r"start of (day|month|year)", text.strip(), re.I)
        if text.strip().lower() in ("utc", "localtime"):
            continue
        if start:
            ts = F.date_trunc(start[1], ts)
        elif m and m[2].lower() in ("month", "year"):
            months = int(float(m[1]) * (12 if m[2].lower() == "year" else 1))
            ts = ts + F.make_interval(months=F.lit(months))
        elif m:
            micros = int(float(m[1]) * {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[m[2].lower()] * 1e6)
            ts = F.timestamp_micros(F.unix_micros(ts) + F.lit(micros))
        else:
            return F.lit(None).cast("timestamp")
    return ts


def parsed(text: Column) -> Column:
    """ISO dates and times; a bare time is on 2000-01-01; null for anything else."""
    full = F.when(text.rlike(r"^\d{2}:\d{2}(:\d{2}(\.\d+)?)?\z"), F.concat(F.lit("2000-01-01 "), text)).otherwise(text)
    return full.try_cast("timestamp")


def from_julian(day: Column) -> Column:
    return F.timestamp_micros(F.round((day - JULIAN_EPOCH) * 86400e6).cast("bigint"))


def date(value: Column, *modifiers: str) -> Column:
    return F.date_format(moment(value, *modifiers), "yyyy-MM-dd")


def time(value: Column, *modifiers: str) -> Column:
    return F.date_format(moment(value, *modifiers), "HH:mm:ss")


def datetime(value: Column, *modifiers: str) -> Column:
    return F.date_format(moment(value, *modifiers), "yyyy-MM-dd HH:mm:ss")


def julianday(value: Column, *modifiers: str) -> Column:
    return F.unix_micros(moment(value, *modifiers)) / F.lit(86400e6) + F.lit(JULIAN_EPOCH)


def _week(ts: Column, first: int) -> Column:
    """Week of the year from 00; weeks begin on Sunday (first 0) or Monday (first 1)."""
    weekday = F.pmod(F.dayofweek(ts) - 1 - first, F.lit(7))
    return F.floor((F.dayofyear(ts) + 6 - weekday) / 7)


def strftime(pattern: str, value: Column, *modifiers: str) -> Column:
    """Compile a literal pattern to one native expression; what is not known is copied through."""
    ts = moment(value, *modifiers)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    blank = lambda c: F.lpad(c.cast("string"), 2, " ")
    hour12 = F.when(F.hour(ts) % 12 == 0, 12).otherwise(F.hour(ts) % 12)
    fmt = lambda p: F.date_format(ts, p)
    codes = {
        "d": lambda: fmt("dd"), "e": lambda: blank(F.dayofmonth(ts)), "f": lambda: F.concat(fmt("ss"), F.lit("."), fmt("SSS")), "F": lambda: fmt("yyyy-MM-dd"),
        "H": lambda: fmt("HH"), "k": lambda: blank(F.hour(ts)), "I": lambda: two(hour12), "l": lambda: blank(hour12), "j": lambda: F.lpad(F.dayofyear(ts).cast("string"), 3, "0"),
        "J": lambda: julianday(ts).cast("string"), "m": lambda: fmt("MM"), "M": lambda: fmt("mm"), "p": lambda: F.when(F.hour(ts) < 12, "AM").otherwise("PM"),
        "P": lambda: F.when(F.hour(ts) < 12, "am").otherwise("pm"), "R": lambda: fmt("HH:mm"), "s": lambda: F.unix_seconds(ts).cast("string"), "S": lambda: fmt("ss"),
        "T": lambda: fmt("HH:mm:ss"), "u": lambda: (F.pmod(F.dayofweek(ts) - 2, F.lit(7)) + 1).cast("string"), "w": lambda: (F.dayofweek(ts) - 1).cast("string"),
        "W": lambda: two(_week(ts, 1)), "U": lambda: two(_week(ts, 0)), "Y": lambda: fmt("yyyy"), "%": lambda: F.lit("%"),
    }
    parts = [codes[p[1]]() if p.startswith("%") and p[1:] in codes else F.lit(p) for p in re.findall(r"%.|[^%]+|%", pattern, re.S)]
    return F.when(ts.isNotNull(), F.concat(*parts)) if parts else F.when(ts.isNotNull(), F.lit(""))
