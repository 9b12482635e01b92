"""Cleaning of the seat-assignment table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from seatwise.config import ChurnConfig
from seatwise.functions.dates import as_date

ASSIGNMENT_COLUMNS = [
    "member_id",
    "contract_id",
    "seat_id",
    "start_time",
    "end_time",
    "seat_created_date",
    "seat_cancelled_date",
    "contract_created_date",
    "contract_cancelled_date",
]


def project_columns(df: DataFrame, columns: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Keep the named columns; a mapping ``new name → source column`` also renames."""
    if isinstance(columns, Mapping):
        return df.select([F.col(source).alias(name) for name, source in columns.items()])
    return df.select(list(columns))


def filter_unassigned(df: DataFrame, marker: str) -> DataFrame:
    """Drop sessions that nobody holds: the marker, or no member at all."""
    return df.filter(F.col("member_id") != F.lit(marker))


def filter_end_before_cancel(df: DataFrame) -> DataFrame:
    """Keep sessions that end on or before the day the seat is cancelled."""
    return df.filter(F.to_date("end_time") <= F.col("seat_cancelled_date"))


def effective_create_date(df: DataFrame) -> DataFrame:
    """Add ``create_date``: the later of seat and contract creation, whichever exists."""
    later = F.greatest("seat_created_date", "contract_created_date")
    return df.withColumn("create_date", as_date(later))


def filter_date_range(df: DataFrame, column: str, first: date, last: date) -> DataFrame:
    """Keep rows whose date lies in ``[first, last]``.

    On a timestamp column Catalyst turns the bounds into timestamp bounds and pushes them to the scan.
    """
    return df.filter(F.to_date(column).between(F.lit(first), F.lit(last)))


def cast_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Timestamps or text → dates."""
    return df.withColumns({name: as_date(F.col(name)) for name in columns})


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def dedup_rows(df: DataFrame) -> DataFrame:
    """One of each group of equal rows.

    Rows are dealt by all their columns first, in ``spark.sql.shuffle.partitions`` parts: a task then holds the distinct rows of
    its part only, not those of whatever the tasks before it read. Copies meet in one task and collapse as they are read.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])  # names may be equal or hold dots
    return numbered.repartition(parts, *numbered.columns).dropDuplicates().toDF(*df.columns)


def clean_assignments(raw: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Raw seat-assignment sessions → distinct, assigned sessions of seats created in the window."""
    df = project_columns(raw, ASSIGNMENT_COLUMNS)
    df = filter_unassigned(df, cfg.unassigned_member)
    df = filter_end_before_cancel(df)
    df = effective_create_date(df)
    df = filter_date_range(df, "create_date", cfg.create_from, cfg.create_to)
    df = drop_columns(df, ["seat_created_date", "contract_created_date"])
    df = cast_dates(df, ["seat_cancelled_date", "contract_cancelled_date"])
    return dedup_rows(df)
