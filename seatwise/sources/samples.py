"""The exported sample table: one row per seat, named columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seatwise.config import ChurnConfig
from seatwise.sources.tables import load_intermediate, write_parquet_overwrite

# The names of an export.
SAMPLE_COLUMNS = [
    "seat_id",
    "contract_id",
    "x",
    "label_seat_daily",
    "label_seat_monthly",
    "seat_create",
    "seat_cancel",
    "label_contract_daily",
    "label_contract_monthly",
    "contract_create",
    "contract_cancel",
]


def export_tensor(samples: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write samples as compressed Parquet under their eleven names.

    ``x`` keeps the days with usage only: ``array<struct<day, f>>``, at most one entry per day of the
    horizon. ``dense_tensor`` gives the full array.
    """
    write_parquet_overwrite(samples.select(SAMPLE_COLUMNS), path, compression)


def load_sample_columns(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Some or all columns of an export; the others are not read."""
    return load_intermediate(spark, path, columns or SAMPLE_COLUMNS)


def explode_tensor(samples: DataFrame) -> DataFrame:
    """``(seat_id, day, f)`` rows of an export."""
    return samples.select("seat_id", F.explode("x").alias("cell")).select("seat_id", "cell.day", "cell.f")


def _with_days(used: Column, days: Column, empty: Column) -> Column:
    """The cells ``used`` and an ``empty`` one for each of ``days`` that has none, sorted by day.

    Missing days are found by hashing and cells put in order by one sort: a lookup of each day in a map would go through all
    used days each time.
    """
    missing = F.array_except(days, F.transform(used, lambda c: c["day"]))
    return F.array_sort(F.concat(used, F.transform(missing, lambda d: F.struct(d.alias("day"), empty.alias("f")))))


def _used(samples: DataFrame) -> Column:
    return F.coalesce("x", F.array().cast(samples.schema["x"].dataType))


def dense_tensor(samples: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """``x`` as a full day × feature array, missing days filled with the missing value; a NULL ``x`` has no days."""
    empty = F.array_repeat(F.lit(cfg.missing_value).cast("bigint"), len(cfg.features))
    inside = F.filter(_used(samples), lambda c: c["day"].between(0, cfg.horizon_days - 1))
    cells = _with_days(inside, F.sequence(F.lit(0), F.lit(cfg.horizon_days - 1)), empty)
    return samples.withColumn("x", F.transform(cells, lambda c: c["f"]))


def fill_life(samples: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """``x`` with an entry for each day of the seat's life too: zeros on days without usage, sorted by day.

    A seat has at most one entry for each day of the horizon.
    """
    first = F.greatest("seat_create", F.lit(0))
    last = F.least(F.coalesce("seat_cancel", F.lit(cfg.horizon_days - 1)), F.lit(cfg.horizon_days - 1))
    life = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), len(cfg.features))
    return samples.withColumn("x", _with_days(_used(samples), life, zeros))
