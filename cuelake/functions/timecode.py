"""Subtitle time codes and whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(value: Column) -> Column:
    return F.when((value >= 0) & (value <= 9), F.concat(F.lit("0"), value.cast("string"))).otherwise(value.cast("string"))


def format_time(ms: Column) -> Column:
    """``HH:MM:SS,mmm``: fractions are cut towards zero, then days and signs follow floor division."""
    whole = ms.cast("long")
    seconds = F.floor(whole / 1000).cast("long")
    minutes = F.floor(seconds / 60).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    tail = F.lpad(F.pmod(whole, F.lit(1000)).cast("string"), 3, "0")
    return F.concat(_two(hours), F.lit(":"), _two(F.pmod(minutes, F.lit(60))), F.lit(":"), _two(F.pmod(seconds, F.lit(60))), F.lit(","), tail)


def parse_time(text: Column) -> Column:
    """Milliseconds of ``HH:MM:SS,m``; what follows the comma is a whole number of ms. Malformed text gives null."""
    part = F.split(text, "[:,]")
    at = lambda i: F.try_element_at(part, F.lit(i)).try_cast("long")
    return at(1) * 3_600_000 + at(2) * 60_000 + at(3) * 1000 + at(4)
