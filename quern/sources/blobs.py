"""Incremental blob access as expressions: read a range of bytes, overwrite a range in place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def read(blob: Column, offset: int, length: int) -> Column:
    return F.substring(blob, offset + 1, length)


def write(blob: Column, offset: int, piece: Column) -> Column:
    """The blob with ``piece`` from ``offset``; its length never changes, so a piece that does not fit gives null."""
    end = F.octet_length(piece) + offset
    size = F.octet_length(blob)
    out = F.concat(F.substring(blob, 1, offset), piece, F.substring(blob, end + 1, F.greatest(size - end, F.lit(0))))
    return F.when(end <= size, out)
