"""Date helpers that stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(end: Column, start: Column) -> Column:
    """Whole days elapsed from ``start`` to ``end`` (timestamp difference reduced to days)."""
    return F.timestamp_diff("DAY", start, end)


def to_timestamp_safe(c: Column, data_type: str) -> Column:
    """Coerce to timestamp without failing under ANSI mode (bad values -> null)."""
    if data_type in ("timestamp", "timestamp_ntz"):
        return c
    if data_type == "date":
        return c.cast("timestamp_ntz")
    return F.try_to_timestamp(c.cast("string"))
