"""String functions with the dialect's semantics, as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that a one-argument trim strips.
WHITE = " \t\n\r\v\f"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def like(text: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE without regard to the case of A-Z only; ``%`` any run, ``_`` any character."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(_literal(pattern[i].translate(str.maketrans(UPPER, LOWER))))
        else:
            out.append({"%": "[\\s\\S]*", "_": "[\\s\\S]"}.get(c) or _literal(c.translate(str.maketrans(UPPER, LOWER))))
        i += 1
    return ascii_lower(text).rlike("^" + "".join(out) + "\\z")


def glob(text: Column, pattern: str) -> Column:
    """GLOB: ``*``, ``?``, ``[a-z]``, ``[^...]``, case-sensitive."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] != "^" else i + 3) if c == "[" else -1
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif end > 0:
            body = pattern[i + 1 : end]
            negated, body = body.startswith("^"), body.removeprefix("^")
            out.append("[" + "^" * negated + "".join(x if x == "-" else _literal(x) for x in body) + "]")
            i = end
        else:
            out.append(_literal(c))
        i += 1
    return text.rlike("^" + "".join(out) + "\\z")


def _literal(c: str) -> str:
    return c if c.isalnum() or c == " " else "\\" + c if c.isascii() else c


def substr(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; start 0 uses up one of the length, a negative start counts from the end, a negative length takes what is before."""
    n = F.length(text)
    s = (F.lit(start) if isinstance(start, int) else start).cast("int")
    # position of the first character, 1-based, before clipping
    first = F.when(s > 0, s).when(s < 0, n + s + 1).otherwise(F.lit(0))
    if length is None:
        return F.substring(text, F.greatest(first, F.lit(1)), n)
    k = (F.lit(length) if isinstance(length, int) else length).cast("int")
    a = F.when(k >= 0, first).otherwise(first + k)
    b = F.when(k >= 0, first + k).otherwise(first)  # exclusive
    a = F.greatest(a, F.lit(1))
    return F.when(F.isnull(text) | F.isnull(s) | F.isnull(k), F.lit(None).cast("string")).otherwise(F.substring(text, a, F.greatest(b - a, F.lit(0))))


def trim(text: Column, chars: str = WHITE, side: str = "both") -> Column:
    """Strip any of ``chars`` (white space by default) from the side or sides."""
    if not chars:
        return text
    of = "[" + "".join(_literal(c) if c.isalnum() or c == " " else f"\\x{{{ord(c):x}}}" for c in chars) + "]+"
    pattern = {"both": f"^{of}|{of}\\z", "left": f"^{of}", "right": f"{of}\\z"}[side]
    return F.regexp_replace(text, pattern, "")


def char(*codes: Column) -> Column:
    """Text of code points; nulls are left out.  UTF-32 bytes decoded by the JVM, so any code point is native."""
    parts = [F.coalesce(F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), "UTF-32"), F.lit("")) for c in codes]
    return F.concat(*parts)


def unicode(text: Column) -> Column:
    """First code point; null for empty text."""
    return F.when(F.length(text) > 0, F.ascii(text))


def instr(text: Column, needle: Column) -> Column:
    return F.instr(text, needle).cast("bigint")


def hexed(c: Column) -> Column:
    return F.hex(c)


def unhexed(text: Column, ignore: str = "") -> Column:
    """Bytes of hexadecimal digits; null if anything else is left after ``ignore``."""
    t = F.translate(text, ignore, "") if ignore else text
    return F.when(t.rlike("^([0-9A-Fa-f]{2})*\\z"), F.unhex(t))


def zeroblob(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.greatest(n.cast("int"), F.lit(0))))


def printf(pattern: str, *args: Column) -> Column:
    """%d %i %s %f %g %c %x %X %% with flags, width and precision as usual."""
    return F.format_string(re.sub(r"%([-+ 0#,]*\d*)i", r"%\1d", pattern), *args)


def number_text(c: Column) -> Column:
    """A double as ``%g``-like text: integral values without a fraction."""
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
