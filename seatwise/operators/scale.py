"""Scaling by the training rows, per time step and feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def fit_std_scaler(train: DataFrame, features: Sequence[str], step: str = "month") -> DataFrame:
    """One row per step: population standard deviation of each feature, missing values skipped."""
    return train.groupBy(step).agg(
        *[F.stddev_pop(F.col(f).cast("double")).alias(f"std_{f}") for f in features]
    )


def fit_standardizer(train: DataFrame, features: Sequence[str], step: str = "month") -> DataFrame:
    """``fit_std_scaler`` plus the mean of each feature."""
    return train.groupBy(step).agg(
        *[F.stddev_pop(F.col(f).cast("double")).alias(f"std_{f}") for f in features],
        *[F.avg(F.col(f).cast("double")).alias(f"mean_{f}") for f in features],
    )


def _join_state(df: DataFrame, state: DataFrame, step: str) -> DataFrame:
    # The state has one row per time step: bounded by the horizon, whatever the data size.
    return df.join(F.broadcast(state), step, "left")


def apply_std_scaler(df: DataFrame, state: DataFrame, features: Sequence[str], step: str = "month") -> DataFrame:
    """Divide by the fitted standard deviation; NULL where it is 0 or unknown."""
    scaled = {f: F.try_divide(F.col(f).cast("double"), F.col(f"std_{f}")) for f in features}
    return _join_state(df, state, step).withColumns(scaled).select(df.columns)


def standardize(df: DataFrame, state: DataFrame, features: Sequence[str], step: str = "month") -> DataFrame:
    """Subtract the fitted mean and divide by the fitted standard deviation."""
    scaled = {
        f: F.try_divide(F.col(f).cast("double") - F.col(f"mean_{f}"), F.col(f"std_{f}")) for f in features
    }
    return _join_state(df, state, step).withColumns(scaled).select(df.columns)


# ---- states that are stored by part of the data and merged ------------------------------------------


def scaler_moments(rows: DataFrame, features: Sequence[str], step: str = "month") -> DataFrame:
    """``(step, feature, n, mean, m2)``: count, mean and sum of squared deviations of each feature, missing values skipped.

    One row for each step and feature, however many rows there are: what is kept of a part of the data.
    """
    sums = rows.groupBy(step).agg(
        *[F.count(f).alias(f"n_{i}") for i, f in enumerate(features)],
        *[F.avg(F.col(f).cast("double")).alias(f"mean_{i}") for i, f in enumerate(features)],
        *[F.var_pop(F.col(f).cast("double")).alias(f"var_{i}") for i, f in enumerate(features)],
    )
    each = [
        F.struct(F.lit(f).alias("feature"), F.col(f"n_{i}").alias("n"), F.col(f"mean_{i}").alias("mean"), (F.col(f"var_{i}") * F.col(f"n_{i}")).alias("m2"))
        for i, f in enumerate(features)
    ]
    return sums.select(step, F.inline(F.array(*each)))


def merge_moments(states: DataFrame, step: str = "month") -> DataFrame:
    """The moments of all parts together, in the form of ``scaler_moments``.

    Squared deviations are moved to the common mean, ``m2 + n * (mean - common)^2``: nothing large is subtracted, so values
    far from 0 keep their digits. Without values the mean and the deviations are NULL.
    """
    common = states.groupBy(step, "feature").agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("common"))
    # One row for each step and feature: bounded by the horizon, whatever the data size.
    moved = states.join(F.broadcast(common), [step, "feature"])
    away = F.col("mean") - F.col("common")
    return moved.groupBy(step, "feature").agg(
        F.sum("n").alias("n"), F.first("common").alias("mean"), F.sum(F.col("m2") + F.col("n") * away * away).alias("m2")
    )


def scaler_of(moments: DataFrame, features: Sequence[str], step: str = "month") -> DataFrame:
    """The state that ``apply_std_scaler`` and ``standardize`` take."""
    std = F.sqrt(F.try_divide("m2", "n"))
    return moments.groupBy(step).agg(
        *[F.max(F.when(F.col("feature") == f, std)).alias(f"std_{f}") for f in features],
        *[F.max(F.when(F.col("feature") == f, F.col("mean"))).alias(f"mean_{f}") for f in features],
    )


def store_moments(rows: DataFrame, features: Sequence[str], path: str, part: str, step: str = "month") -> None:
    """Keep the moments of one part of the data, such as an arrival or a group of contracts, below ``path``. A part that
    is stored again replaces its earlier moments, so a correction does not count twice."""
    scaler_moments(rows, features, step).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={part}")


def stored_scaler(spark: SparkSession, features: Sequence[str], path: str, step: str = "month") -> DataFrame:
    """The scaler of all parts stored below ``path``; the rows themselves are not read again."""
    return scaler_of(merge_moments(spark.read.parquet(path), step), features, step)
