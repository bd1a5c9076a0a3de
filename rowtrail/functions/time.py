"""Timestamps: parsing, differences in days, parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
PARTS = ("year", "month", "day", "hour", "total_seconds")


def parse(column: Column | str) -> Column:
    """Text to timestamp; what cannot be parsed becomes NULL."""
    return F.try_to_timestamp(F.col(column) if isinstance(column, str) else column)


def _micros(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def whole_days(later: Column, earlier: Column) -> Column:
    """Full days between two timestamps, rounded down: one hour early is -1."""
    return F.floor(_micros(later, earlier) / F.lit(DAY_MICROS)).cast("long")


def fractional_days(later: Column, earlier: Column) -> Column:
    return _micros(later, earlier) / F.lit(DAY_MICROS)


def flag(condition: Column) -> Column:
    """A condition as 0/1; unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def parts(column: str) -> dict[str, Column]:
    """Year, month, day, hour and seconds since 1970 of a timestamp, as numbers."""
    c = F.col(column)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return {
        f"{column}_year": F.year(c),
        f"{column}_month": F.month(c),
        f"{column}_day": F.dayofmonth(c),
        f"{column}_hour": F.hour(c),
        f"{column}_total_seconds": F.timestamp_diff("SECOND", epoch, c.cast("timestamp_ntz")),
    }
