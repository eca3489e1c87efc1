"""Intervals, buckets and statuses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ACTIVE, OPEN_ENDED, STATUS_NAMES


def covers(valid_from: Column, valid_to: Column, t: int | Column) -> Column:
    """Half-open interval [valid_from, valid_to); valid_to 0 has no end."""
    t = F.lit(t) if isinstance(t, int) else t
    return (valid_from <= t) & ((valid_to == OPEN_ENDED) | (valid_to > t))


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return ((b_to == OPEN_ENDED) | (a_from < b_to)) & ((a_to == OPEN_ENDED) | (b_from < a_to))


def bucket(t: Column, width: int) -> Column:
    """Start of t's bucket, also before the epoch; integer arithmetic only."""
    return t - F.pmod(t, F.lit(width).cast("bigint"))


def status_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATUS_NAMES)), code.cast("int") + 1)


def is_current() -> Column:
    return (F.col("status_code") == ACTIVE) & (F.col("valid_to") == OPEN_ENDED)
