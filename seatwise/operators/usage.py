"""Sums of assigned usage per category, day and seat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seatwise.config import ChurnConfig
from seatwise.functions.dates import day_index


def time_sums(categories: Sequence[str]) -> list[Column]:
    """Total session time of each category, 0 where there is none."""
    return [
        F.sum(F.when(F.col("product_name") == c, F.coalesce("session_time", F.lit(0))).otherwise(F.lit(0)))
        .cast("bigint")
        .alias(f"time_{c}")
        for c in categories
    ]


def count_sums(categories: Sequence[str]) -> list[Column]:
    """Number of sessions of each category."""
    return [F.count_if(F.col("product_name") == c).alias(f"count_{c}") for c in categories]


def sum_by_category(df: DataFrame, keys: Sequence[str], categories: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*time_sums(categories))


def count_by_category(df: DataFrame, keys: Sequence[str], categories: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*count_sums(categories))


def category_vocabulary(df: DataFrame) -> DataFrame:
    """The categories that occur, in feature order."""
    return df.select(F.col("product_name").alias("category")).distinct().orderBy("category")


def seat_dates(assigned: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Assigned usage per seat, contract and date: the table every later step starts from.

    Holds the feature sums plus the earliest dates, so features, labels and day 0 all come from this
    one aggregation of the events.
    """
    return assigned.groupBy("seat_id", "contract_id", "event_date").agg(
        *time_sums(cfg.categories),
        *count_sums(cfg.categories),
        F.min("create_date").alias("create_date"),
        F.min("seat_cancelled_date").alias("seat_cancelled_date"),
        F.min("contract_cancelled_date").alias("contract_cancelled_date"),
    )


def global_min_date(df: DataFrame, column: str = "create_date") -> DataFrame:
    """One row: the earliest date, as ``day_zero``."""
    return df.agg(F.min(column).alias("day_zero"))


def constant_column(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table to every row: scalar subqueries, run once, inside the same plan."""
    return df.withColumns({name: one_row.select(name).scalar() for name in one_row.columns})


def with_day_zero(df: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Add ``day_zero``: the pinned date, or the earliest creation date in ``df``."""
    if cfg.day_zero is not None:
        return df.withColumn("day_zero", F.lit(cfg.day_zero))
    return constant_column(df, global_min_date(df))


def with_day(df: DataFrame, date_column: str = "event_date", name: str = "day") -> DataFrame:
    return df.withColumn(name, day_index(F.col(date_column), F.col("day_zero")))


def seat_days(dates: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """``(seat_id, day, features…)`` for the days with usage inside the horizon.

    ``dates`` is the output of ``seat_dates`` with ``day_zero``.
    """
    in_horizon = F.col("day").between(0, cfg.horizon_days - 1)
    return (
        with_day(dates).filter(in_horizon)
        .groupBy("seat_id", "day")
        .agg(*[F.sum(f).alias(f) for f in cfg.features])
    )


def pack_features(df: DataFrame, features: Sequence[str], name: str = "f", dtype: str = "bigint") -> DataFrame:
    """Feature columns → one array column."""
    others = [c for c in df.columns if c not in set(features)]
    return df.select(*others, F.array(*[F.col(f).cast(dtype) for f in features]).alias(name))


def daily_feature_vector(dates: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """``(seat_id, day, f)``: all times, then all counts."""
    return pack_features(seat_days(dates, cfg), cfg.features)


def pivot_days(df: DataFrame, key: str, days: Sequence[int], value: Column) -> DataFrame:
    """One column per day from an explicit day list; a day without rows is NULL.

    Width grows with days, so this is for short ranges; the long form is the default everywhere else.
    """
    return df.groupBy(key).pivot("day", list(days)).agg(value)
