"""Sizes and positions of log records, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def record_size(pages: Column, page_size: int, extra: Column) -> Column:
    return F.lit(40).cast("long") + pages * (4 + page_size) + extra


def location(segment: Column, offset: Column) -> Column:
    return F.shiftleft(segment.cast("long"), 32).bitwiseOR(offset.cast("long"))


def segment_of(loc: Column) -> Column:
    return F.shiftrightunsigned(loc, 32)


def offset_of(loc: Column) -> Column:
    return loc.bitwiseAND(0xFFFFFFFF)


def integer_width(v: Column) -> Column:
    """The bytes that an integer takes in the smallest class that holds it."""
    out = F.lit(8)
    for width, bits in ((6, 47), (4, 31), (3, 23), (2, 15), (1, 7)):
        out = F.when(v.between(-(1 << bits), (1 << bits) - 1), width).otherwise(out)
    return F.when(v.isin(0, 1), 0).otherwise(out)


def local_payload(size: Column, usable: int) -> Column:
    """How much of a record stays on its page."""
    most, least = usable - 35, (usable - 12) * 32 // 255 - 23
    k = F.lit(least) + (size - least) % (usable - 4)
    return F.when(size <= most, size).when(k <= most, k).otherwise(least)


def result_class(code: Column) -> Column:
    """What a result code means to a caller: the low byte decides."""
    low = code.bitwiseAND(0xFF)
    return F.when(low == 0, "ok").when(low.isin(5, 6), "retry").when(low == 13, "full").otherwise("error")
