"""From raw tables to model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seatwise.config import ChurnConfig
from seatwise.operators.assign import assigned_usage, prepare_usage
from seatwise.operators.clean import clean_assignments
from seatwise.operators.grid import dense_days, mask_by_label
from seatwise.operators.labels import (
    contract_rollup,
    expand_monthly_to_daily,
    join_features_labels,
    join_seat_contract_labels,
    period_labels,
    sample_labels,
    sample_weights,
    seat_rollup,
    with_day_label,
    with_month_label,
)
from seatwise.operators.months import seat_months
from seatwise.operators.pool import pool_mean_max_min, pool_sum, pooled_names, presence_from_spans
from seatwise.operators.usage import daily_feature_vector, seat_dates, seat_days, with_day_zero
from seatwise.workspace import stage


def assigned_from_raw(assignment: DataFrame, usage: DataFrame, taxonomy: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Raw assignments and raw events → assigned usage.

    The raw events are scanned twice: the search for hot members reads the columns that it needs and shuffles counts,
    the join reads all. Nothing of them is written.
    """
    return assigned_usage(prepare_usage(usage, taxonomy, cfg), clean_assignments(assignment, cfg), cfg)


def dated_usage(assigned: DataFrame, cfg: ChurnConfig, path: str | None = None) -> DataFrame:
    """``seat_dates`` with ``day_zero``, written once as a stage table.

    Day 0, seat months and contract spans all read this table, each its own columns. Without the stage
    each of them would join the events to the seats again.
    """
    return with_day_zero(stage(seat_dates(assigned, cfg), "seat_dates", path), cfg)


def seat_samples(dates: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """One row per seat: usage days, labels and spans of the seat and of its contract."""
    vectors = daily_feature_vector(dates, cfg)
    x = vectors.groupBy("seat_id").agg(F.sort_array(F.collect_list(F.struct("day", "f"))).alias("x"))
    # One row per seat; the search for hot contracts reads it again.
    seats = stage(seat_rollup(dates), "seats")
    spans = join_seat_contract_labels(seats, contract_rollup(dates))
    # A seat whose usage all lies outside the horizon still is a sample, without usage days.
    joined = join_features_labels(x, spans, "right")
    return sample_labels(joined, cfg).select(
        "seat_id",
        "contract_id",
        "x",
        "label_seat_daily",
        "label_seat_monthly",
        F.col("create_day").alias("seat_create"),
        F.col("cancel_day").alias("seat_cancel"),
        "label_contract_daily",
        "label_contract_monthly",
        F.col("contract_create_day").alias("contract_create"),
        F.col("contract_cancel_day").alias("contract_cancel"),
    )


def label_contract_months(
    pooled: DataFrame, dates: DataFrame, features: list[str], cfg: ChurnConfig
) -> DataFrame:
    """Pooled contract months with their contract's led label and weight, NULL outside its life."""
    df = with_month_label(pooled.join(contract_rollup(dates), "contract_id"), cfg)
    df = sample_weights(mask_by_label(df, [*features, "n_seats"]), cfg)
    return df.select("contract_id", "month", *features, "n_seats", "label", "weight")


def prep_seat_monthly(dates: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Seat months: monthly sums, led label, weight."""
    return seat_months(dates, cfg).select("seat_id", "contract_id", "month", *cfg.features, "label", "weight")


def prep_sequence_baseline(dates: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Contract months: monthly sums over live seats, seat count, led label, weight."""
    return label_contract_months(pool_sum(seat_months(dates, cfg), cfg.features), dates, cfg.features, cfg)


def prep_tabular_baseline(dates: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Contract months: monthly and lifetime sums over live seats, seat count, led label, weight."""
    features = cfg.features + cfg.lifetime_features
    return label_contract_months(pool_sum(seat_months(dates, cfg, lifetime=True), features), dates, features, cfg)


def prep_pooled(seat_rows: DataFrame, dates: DataFrame, features: list[str], cfg: ChurnConfig) -> DataFrame:
    """Contract months: mean, max and min of masked seat features, seat count, led label, weight."""
    return label_contract_months(pool_mean_max_min(seat_rows, features), dates, pooled_names(features), cfg)


def prep_seat_daily(dates: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Seat days: features (0 on days of life without usage, NULL outside life) and the daily label.

    A row per seat and day of the horizon: for daily models only, everything monthly starts from the
    days with usage.
    """
    days = dense_days(seat_days(dates, cfg), seat_rollup(dates), cfg.features, cfg.horizon_days)
    return with_day_label(days, cfg).select("seat_id", "day", *cfg.features, "label")


def prep_group_daily(dates: DataFrame, features: list[str], cfg: ChurnConfig) -> DataFrame:
    """Contract days: pooled presence of the seats, and the monthly label on the first day of its period."""
    presence = presence_from_spans(seat_rollup(dates), features, cfg.horizon_days, cfg.missing_value)
    periods = period_labels(contract_rollup(dates), cfg)
    return presence.join(expand_monthly_to_daily(periods, "contract_id", cfg), ["contract_id", "day"])


def contract_month_features(
    assignment: DataFrame, usage: DataFrame, taxonomy: DataFrame, cfg: ChurnConfig
) -> DataFrame:
    """Raw tables → ``prep_sequence_baseline``: the whole chain."""
    dates = dated_usage(assigned_from_raw(assignment, usage, taxonomy, cfg), cfg)
    return prep_sequence_baseline(dates, cfg)
