"""Day and period arithmetic on dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

EPOCH = date(1970, 1, 1)


def as_date(column: Column) -> Column:
    """Date of a date or timestamp; NULL for text that is no date."""
    return column.try_cast("date")


def day_index(day: Column, day_zero: Column) -> Column:
    """Whole days from ``day_zero`` to ``day``."""
    return F.datediff(day, day_zero)


def period_index(day: Column, period_days: int) -> Column:
    """Period (``period_days`` long) that a day number falls into."""
    return F.floor(day / F.lit(period_days)).cast("int")


def time_bucket(day: Column, bucket_days: int) -> Column:
    """Fixed calendar bucket of a date, the same for every table."""
    return period_index(F.datediff(day, F.lit(EPOCH)), bucket_days)
