"""Days rolled into months, per seat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seatwise.config import ChurnConfig
from seatwise.functions.dates import day_index, period_index
from seatwise.operators.grid import mask_by_label
from seatwise.operators.labels import sample_weights, with_month_label
from seatwise.operators.usage import with_day


def _in_sum(cfg: ChurnConfig):
    return F.col("day") % cfg.period_days < cfg.summed_days


def monthly_sum(days: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """``(seat_id, month, features…)`` of the months with usage; the last day of a month is not summed."""
    month = period_index(F.col("day"), cfg.period_days)
    return (
        days.filter(_in_sum(cfg)).withColumn("month", month)
        .filter(F.col("month") < cfg.n_months)
        .groupBy("seat_id", "month")
        .agg(*[F.sum(f).alias(f) for f in cfg.features])
    )


def seat_month_usage(dates: DataFrame, cfg: ChurnConfig, lifetime: bool = False) -> DataFrame:
    """All months of every seat, with its span: monthly sums and, if asked, lifetime sums.

    ``dates`` is the output of ``seat_dates`` with ``day_zero``. The lifetime sum of month m covers all
    days up to the last summed day of m, so it includes the unsummed days of the months before.

    Two shuffles: (seat, contract, month) after a map-side combine, then seat. Each seat then has at most
    ``n_months + 1`` rows, and windows over them fill the gaps: a row also stands for the empty months
    that follow it, and the first row for those before it.
    """
    features, n = cfg.features, cfg.n_months
    last_day = min(cfg.horizon_days, n * cfg.period_days)
    # Slot n collects usage outside the feature months: no features, but the seat exists.
    slot = F.when(F.col("day").between(0, last_day - 1), period_index(F.col("day"), cfg.period_days))
    sums = [F.sum(F.when(_in_sum(cfg), F.col(f)).otherwise(F.lit(0))).alias(f) for f in features]
    if lifetime:
        sums += [F.sum(f).alias(f"full_{f}") for f in features]
    by_contract = (
        with_day(dates)
        .withColumn("_month", F.coalesce(slot, F.lit(n)))
        .groupBy("seat_id", "contract_id", "_month")
        .agg(
            *sums,
            F.min(day_index(F.col("create_date"), F.col("day_zero"))).alias("create_day"),
            F.min(day_index(F.col("seat_cancelled_date"), F.col("day_zero"))).alias("cancel_day"),
        )
    )
    # The least contract is found here and not above: a minimum of text cannot be hash-aggregated, and at
    # this point the sort it needs instead is the one of the windows. Partitioned by seat, nothing more moves.
    carried = features + ([f"full_{f}" for f in features] if lifetime else [])
    spans = ["contract_id", "create_day", "cancel_day"]
    sparse = (
        by_contract.repartition("seat_id")
        .groupBy("seat_id", "_month")
        .agg(*[F.sum(f).alias(f) for f in carried], *[F.min(c).alias(c) for c in spans])
    )

    by_month = Window.partitionBy("seat_id").orderBy("_month")
    whole = by_month.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = {c: F.min(c).over(whole) for c in spans}
    columns["_first"] = F.when(F.lag("_month").over(by_month).isNull(), 0).otherwise(F.col("_month"))
    columns["_last"] = F.coalesce(F.lead("_month").over(by_month), F.lit(n)) - 1
    if lifetime:
        so_far = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        columns |= {f"run_{f}": F.sum(f"full_{f}").over(so_far) for f in features}

    rows = sparse.withColumns(columns).filter(F.col("_first") <= F.col("_last"))
    rows = rows.withColumn("month", F.explode(F.sequence("_first", "_last")))
    own, later = F.col("month") == F.col("_month"), F.col("month") > F.col("_month")
    result = [F.when(own, F.col(f)).otherwise(F.lit(0)).alias(f) for f in features]
    if lifetime:
        result += [
            F.when(own, F.col(f"run_{f}") - F.col(f"full_{f}") + F.col(f))
            .when(later, F.col(f"run_{f}"))
            .otherwise(F.lit(0))
            .alias(f"life_{f}")
            for f in features
        ]
    return rows.select("seat_id", *spans, "month", *result)


def seat_months(dates: DataFrame, cfg: ChurnConfig, lifetime: bool = False) -> DataFrame:
    """``seat_month_usage`` with led label and weight, features NULL outside life."""
    features = cfg.features + (cfg.lifetime_features if lifetime else [])
    df = with_month_label(seat_month_usage(dates, cfg, lifetime), cfg)
    return sample_weights(mask_by_label(df, features), cfg)
