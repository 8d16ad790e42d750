"""Date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_life(value: Column, age_days: Column, days: float) -> Column:
    """value * exp(-ln 2 / days * age)."""
    return value * F.exp(-F.log(F.lit(2.0)) / days * age_days)


def recency(age_days: Column) -> Column:
    return 1.0 / (1 + age_days / 30.0)


def local_date(ts: Column, zone: str) -> Column:
    """The calendar day of a UTC time in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))
