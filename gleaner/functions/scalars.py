"""Scalar helpers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half(x: Column, places: int = 0) -> Column:
    return F.round(x, places)


def round_away(x: Column, places: int = 0) -> Column:
    """Truncated, plus one step away from zero, even if nothing was cut off."""
    s = F.lit(10.0**places)
    cut = F.signum(x) * F.floor(F.abs(x) * s)
    return (cut + F.when(x < 0, -1.0).otherwise(1.0)) / s


def round_down(x: Column, places: int = 0) -> Column:
    s = F.lit(10.0**places)
    return F.signum(x) * F.floor(F.abs(x) * s) / s


def is_int(x: Column) -> Column:
    return x.rlike(r"^\p{Nd}+$") & ~x.rlike("^0.")


def is_numeric(x: Column) -> Column:
    return x.try_cast("double").isNotNull()


def to_long(x: Column) -> Column:
    return F.coalesce(x.try_cast("bigint"), F.lit(0))


def next_divisible(x: Column, n: int) -> Column:
    """x if n divides it, else the next multiple of n."""
    return F.when(x % n == 0, x).otherwise((F.floor(x / n) + 1) * n).cast("long")


def add_days(at: Column, days: int) -> Column:
    """Unix seconds some calendar days later, at the same time of day in the session's time zone."""
    return F.unix_timestamp(F.timestamp_seconds(at) + F.make_interval(days=F.lit(days)))
