"""Life spans and churn labels of seats and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seatwise.config import ChurnConfig
from seatwise.functions.dates import day_index, period_index
from seatwise.functions.labels import label_array, label_at, label_weight
from seatwise.operators.grid import dense_grid
from seatwise.operators.skew import skew_join


def seat_rollup(dates: DataFrame) -> DataFrame:
    """Per seat: contract, first creation day, first cancellation day (days since day 0).

    Reduced to (seat, contract) first: that is a hash aggregation, whereas the least contract, a text,
    needs a sort, which then is over far fewer rows.
    """
    by_contract = dates.groupBy("seat_id", "contract_id").agg(
        F.min(day_index(F.col("create_date"), F.col("day_zero"))).alias("create_day"),
        F.min(day_index(F.col("seat_cancelled_date"), F.col("day_zero"))).alias("cancel_day"),
    )
    return by_contract.groupBy("seat_id").agg(
        *[F.min(c).alias(c) for c in ("contract_id", "create_day", "cancel_day")]
    )


def contract_rollup(dates: DataFrame) -> DataFrame:
    """Per contract: first creation day over its used seats, first cancellation day."""
    return dates.groupBy("contract_id").agg(
        F.min(day_index(F.col("create_date"), F.col("day_zero"))).alias("create_day"),
        F.min(day_index(F.col("contract_cancelled_date"), F.col("day_zero"))).alias("cancel_day"),
    )


def _periods(cfg: ChurnConfig):
    return (
        period_index(F.col("create_day"), cfg.period_days),
        period_index(F.col("cancel_day"), cfg.period_days),
    )


def daily_labels(spans: DataFrame, cfg: ChurnConfig, name: str = "label_daily") -> DataFrame:
    labels = label_array(F.col("create_day"), F.col("cancel_day"), cfg.horizon_days)
    return spans.withColumn(name, labels)


def monthly_labels(spans: DataFrame, cfg: ChurnConfig, name: str = "label_monthly") -> DataFrame:
    return spans.withColumn(name, label_array(*_periods(cfg), cfg.n_periods))


def contract_labels(dates: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Daily and monthly label arrays of every contract."""
    return monthly_labels(daily_labels(contract_rollup(dates), cfg), cfg)


def period_labels(spans: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Long form of the monthly labels: one row per period."""
    grid = dense_grid(spans, cfg.n_periods, "period")
    return grid.withColumn("label", label_at(F.col("period"), *_periods(cfg), cfg.n_periods))


def with_day_label(df: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Add the daily label to rows that have ``day``, ``create_day`` and ``cancel_day``."""
    label = label_at(F.col("day"), F.col("create_day"), F.col("cancel_day"), cfg.horizon_days)
    return df.withColumn("label", label)


def day_labels(spans: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Long form of the daily labels: one row per day."""
    return with_day_label(dense_grid(spans, cfg.horizon_days, "day"), cfg)


def lead_labels(periods: DataFrame) -> DataFrame:
    """Pair month m with the label of period m + 1; period 0 is never predicted."""
    return (
        periods.filter(F.col("period") >= 1)
        .withColumn("month", F.col("period") - 1)
        .drop("period")
    )


def with_month_label(df: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Add the led label to rows that have ``month``, ``create_day`` and ``cancel_day``."""
    return df.withColumn("label", label_at(F.col("month") + 1, *_periods(cfg), cfg.n_periods))


def sample_weights(df: DataFrame, cfg: ChurnConfig) -> DataFrame:
    return df.withColumn("weight", label_weight(F.col("label"), cfg.positive_weight))


def expand_monthly_to_daily(periods: DataFrame, key: str, cfg: ChurnConfig) -> DataFrame:
    """Put the label of period p on day ``p * period_days``, with weight 1 unless it lies outside life.

    All other days have label 0 and weight 0. Each period expands to its own days, the last one to the horizon, so no
    join is needed.
    """
    first_day = F.col("period") * cfg.period_days
    last_day = F.least(first_day + cfg.period_days - 1, F.lit(cfg.horizon_days - 1))
    last_day = F.when(F.col("period") == cfg.n_periods - 1, F.lit(cfg.horizon_days - 1)).otherwise(last_day)
    days = (
        periods.filter(first_day < cfg.horizon_days)
        .withColumn("day", F.explode(F.sequence(first_day, last_day)))
    )
    on_first = F.col("day") == F.col("period") * cfg.period_days
    return days.select(
        key,
        "day",
        F.when(on_first, F.col("label")).otherwise(F.lit(0)).alias("label"),
        F.when(on_first & (F.col("label") != -1), F.lit(1)).otherwise(F.lit(0)).alias("weight"),
    )


def join_seat_contract_labels(seats: DataFrame, contracts: DataFrame) -> DataFrame:
    """Seat spans with the span of their contract.

    A contract with a third of all seats is split, and the label arrays are made after the join so that the shuffle carries day numbers only.
    """
    spans = contracts.select(
        "contract_id",
        F.col("create_day").alias("contract_create_day"),
        F.col("cancel_day").alias("contract_cancel_day"),
    )
    return skew_join(seats, spans, ["contract_id"], ["seat_id"])


def join_features_labels(features: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """Seat features with seat labels; a seat has at most one row per day on the left and one on the right."""
    return features.join(labels, "seat_id", how)


def sample_labels(spans: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """The four label arrays of a sample, from joined seat and contract spans."""
    def arrays(prefix: str, create: str, cancel: str):
        created, cancelled = F.col(create), F.col(cancel)
        periods = [period_index(c, cfg.period_days) for c in (created, cancelled)]
        return {
            f"label_{prefix}_daily": label_array(created, cancelled, cfg.horizon_days),
            f"label_{prefix}_monthly": label_array(*periods, cfg.n_periods),
        }

    return spans.withColumns(
        arrays("seat", "create_day", "cancel_day")
        | arrays("contract", "contract_create_day", "contract_cancel_day")
    )
