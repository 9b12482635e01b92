"""Seats pooled into contracts. Every pool is a partial-then-final aggregation, so a contract with a
third of all seats is reduced on the map side first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def pool_sum(df: DataFrame, features: Sequence[str], step: str = "month") -> DataFrame:
    """Per contract and step: sum of each feature over live seats (0 if none), live seats (NULL if none)."""
    return df.groupBy("contract_id", step).agg(
        *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in features],
        F.nullif(F.count(features[0]), F.lit(0)).alias("n_seats"),
    )


def pooled_names(features: Sequence[str]) -> list[str]:
    return [f"{kind}_{f}" for kind in ("mean", "max", "min") for f in features]


def pool_mean_max_min(df: DataFrame, features: Sequence[str], step: str = "month") -> DataFrame:
    """Per contract and step: mean, max and min of each feature over live seats, and their number; 0 if none."""
    kinds = {"mean": F.avg, "max": F.max, "min": F.min}
    return df.groupBy("contract_id", step).agg(
        *[
            F.coalesce(how(F.col(f).cast("double")), F.lit(0.0)).alias(f"{kind}_{f}")
            for kind, how in kinds.items()
            for f in features
        ],
        F.count(features[0]).alias("n_seats"),
    )


def pool_presence(df: DataFrame, features: Sequence[str], step: str = "day", missing: int = -1) -> DataFrame:
    """Per contract and step: share of all seats with the feature present, whether any / all have it,
    and the number of live seats (``missing`` if none). Pools presence, not values."""
    present = {f: F.col(f).isNotNull().cast("int") for f in features}
    kinds = {"mean": F.avg, "max": F.max, "min": F.min}
    live = F.count(features[0])
    return df.groupBy("contract_id", step).agg(
        *[
            how(flag).cast("double").alias(f"{kind}_{f}")
            for kind, how in kinds.items()
            for f, flag in present.items()
        ],
        F.when(live == 0, F.lit(missing)).otherwise(live).alias("n_seats"),
    )


def presence_from_spans(spans: DataFrame, features: Sequence[str], n_steps: int, missing: int = -1) -> DataFrame:
    """``pool_presence`` over days, for features that are present exactly while the seat is alive.

    Counts arrivals and departures per (contract, day) and sums them up along the days, instead of making
    a row per seat and day: a seat costs two rows, a contract ``n_steps``.
    """
    cancelled = F.col("cancel_day")
    # A life that began before day 0 counts from day 0 on. One cancelled before its creation is the cancel day alone.
    first = F.when(cancelled < F.col("create_day"), cancelled).otherwise(F.greatest("create_day", F.lit(0)))
    last = F.least(F.coalesce(cancelled, F.lit(n_steps - 1)), F.lit(n_steps - 1))
    lives = spans.select("contract_id", first.alias("_first"), last.alias("_last")).filter(
        (F.col("_first") >= 0) & (F.col("_first") <= F.col("_last"))
    )
    change = F.explode(
        F.array(
            F.struct(F.col("_first").alias("day"), F.lit(1).alias("change")),
            F.struct((F.col("_last") + 1).alias("day"), F.lit(-1).alias("change")),
        )
    )
    changes = lives.select("contract_id", change.alias("c")).select(
        "contract_id", "c.day", "c.change", F.lit(0).cast("bigint").alias("seats")
    )
    grid = (
        spans.groupBy("contract_id").agg(F.count(F.lit(1)).alias("seats"))
        .select("contract_id", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("day"), F.lit(0).alias("change"), "seats")
    )
    per_day = (
        changes.filter(F.col("day") < n_steps).unionByName(grid)
        .groupBy("contract_id", "day")
        .agg(F.sum("change").alias("change"), F.sum("seats").alias("seats"))
    )
    by_day = Window.partitionBy("contract_id").orderBy("day")
    live = F.sum("change").over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = per_day.withColumn("live", live)
    kinds = {
        "mean": F.col("live") / F.col("seats"),
        "max": (F.col("live") > 0).cast("double"),
        "min": (F.col("live") == F.col("seats")).cast("double"),
    }
    return counted.select(
        "contract_id",
        "day",
        *[value.alias(f"{kind}_{f}") for kind, value in kinds.items() for f in features],
        F.when(F.col("live") == 0, F.lit(missing)).otherwise(F.col("live")).alias("n_seats"),
    )


def attach_group_id(features: DataFrame, seats: DataFrame) -> DataFrame:
    """Seat rows with their contract, by key. A seat has few rows (one per step) on the left, one on the right."""
    return features.join(seats.select("seat_id", "contract_id"), "seat_id")


def group_label(df: DataFrame, label: str = "label", step: str = "month") -> DataFrame:
    """The contract's label from the copies on its seats (they are all equal)."""
    return df.groupBy("contract_id", step).agg(F.min(label).alias(label))
