"""Recurrent churn models: contract months, seat months with their latent states, and contracts on top of seats."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from seatwise.config import ChurnConfig
from seatwise.functions.labels import ALIVE, CHURN
from seatwise.functions.vectors import total
from seatwise.operators.evaluate import filter_scored
from seatwise.operators.grid import day_runs
from seatwise.operators.labels import seat_rollup
from seatwise.operators.pool import pooled_names
from seatwise.operators.usage import seat_days
from seatwise.plans.models import FOLD_SEED, N_FOLDS, encode_features, scale_months, with_split
from seatwise.plans.prep import prep_pooled
from seatwise.training.epochs import Schedule
from seatwise.training.recurrent import RecurrentConfig, RecurrentModel, fit_recurrent, staged_sequences
from seatwise.workspace import stage


def month_sequences(prep: DataFrame, features: Sequence[str], cfg: ChurnConfig, key: str = "contract_id") -> DataFrame:
    """Scaled and encoded months inside life as one sequence for each ``key``: what ``fit_recurrent`` takes."""
    scaled = scale_months(stage(with_split(prep), "months"), features)
    return staged_sequences(filter_scored(encode_features(scaled, features, cfg)), key, "month", features)


# A day's gradient goes back through the days of its own span of 30.
DAILY = RecurrentConfig(truncate=30, batch=64)


def seat_day_sequences(dates: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """The days of each seat's life as one sequence, with its contract's split.

    Features are divided by their deviation over all train days (one number for each feature: a day of its own has too few
    seats with use), weights are 1. A seat has at most ``horizon_days`` steps, which bounds a row.
    """
    seats = seat_rollup(dates)
    runs = day_runs(seat_days(dates, cfg), seats, cfg.features, cfg.horizon_days).join(seats.select("seat_id", "contract_id"), "seat_id")
    runs = stage(with_split(_live_runs(runs, cfg)), "seat_runs")
    deviation = _deviations(runs.filter(F.col("split") == "train"), cfg.features)
    x = F.array(*[F.coalesce(F.try_divide(F.col(f).cast("double"), F.lit(deviation[f]).cast("double")), F.lit(float(cfg.missing_value))) for f in cfg.features])
    # What moves is a row for each run; the days of a seat are put together from its runs in its own row. Runs are small and every
    # epoch works on the days, so the number of parts is fixed.
    item = F.struct("first", "last", "label", x.alias("x"))
    n_parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seat = runs.repartition(n_parts, "seat_id").groupBy("seat_id", "split").agg(F.array_sort(F.collect_list(item)).alias("s"))
    size = lambda r: r["last"] - r["first"] + 1
    rows = seat.select(
        "seat_id", "split", F.xxhash64("seat_id").alias("mark"), F.flatten(F.transform("s", lambda r: F.sequence(r["first"], r["last"]))).alias("steps"),
        F.flatten(F.flatten(F.transform("s", lambda r: F.array_repeat(r["x"], size(r))))).alias("x"),
        F.flatten(F.transform("s", lambda r: F.array_repeat(r["label"], size(r)))).alias("label"),
    )
    return stage(rows.withColumn("weight", F.array_repeat(F.lit(1.0), F.size("steps"))), "sequences")


def _live_runs(runs: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """``day_runs`` cut to the days that have a label, with it: the days alive, and the day of cancellation on its own."""
    first, last, created, cancelled, n = F.col("first"), F.col("last"), F.col("create_day"), F.col("cancel_day"), cfg.horizon_days
    censored = cancelled.isNull() | (cancelled >= n)
    end = F.when(censored, F.lit(n - 1)).otherwise(cancelled - 1)
    # A cancellation before day 0 or creation leaves no day alive.
    alive = F.struct(F.greatest(first, F.coalesce(created, F.lit(n))).alias("first"), F.least(last, end).alias("last"), F.lit(float(ALIVE)).alias("label"))
    churn = F.struct(F.when(~censored & cancelled.between(first, last), cancelled).alias("first"), cancelled.alias("last"), F.lit(float(CHURN)).alias("label"))
    cut = runs.select("seat_id", "contract_id", *cfg.features, F.inline(F.array(alive, churn)))
    return cut.filter(F.col("first") <= F.col("last"))


def _deviations(runs: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """Population deviation of each feature over the days of ``runs``, from exact sums; None without values."""
    days = (F.col("last") - F.col("first") + 1).cast("decimal(6,0)")
    sums = []
    for f in features:
        value = F.col(f).cast("decimal(12,0)")
        sums += [F.sum(F.when(value.isNotNull(), days)).alias(f"n_{f}"), F.sum(days * value).cast("string").alias(f"s_{f}"), F.sum(days * value * value).cast("string").alias(f"q_{f}")]
    row = runs.agg(*sums).first()  # one row
    found = {}
    for f in features:
        n, s, q = (int(row[f"{k}_{f}"] or 0) for k in "nsq")
        found[f] = math.sqrt(Fraction(n * q - s * s, n * n)) if n else None
    return found


def latent_names(units: int) -> list[str]:
    return [f"latent_{i}" for i in range(units)]


def _fold(contract: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(FOLD_SEED), contract), F.lit(N_FOLDS)).cast("int")


def seat_latent_states(
    seat_rows: DataFrame, cfg: ChurnConfig, config: RecurrentConfig = RecurrentConfig(), schedule: Schedule = Schedule()
) -> DataFrame:
    """Stage 1: per seat month the squeezed features and the state of the seat's memory, ``latent_0`` and on.

    Seats of train contracts get the states of a model that has not seen their contract's fold, the others those of a
    model of all train contracts. Months outside life are kept, with NULLs. ``seat_rows`` is the output of
    ``prep_seat_monthly``; every live month counts alike.
    """
    features = cfg.features
    months = stage(scale_months(stage(with_split(seat_rows), "seat_months"), features), "scaled_seat_months")
    live = encode_features(filter_scored(months), features, cfg).withColumn("weight", F.lit(1.0))
    squeezed = live.select("seat_id", "month", total(cfg.time_features).alias("squeezed_time"), total(cfg.count_features).alias("squeezed_count"))
    table = staged_sequences(live, "seat_id", "month", features, keep=["contract_id"])

    train, fold = F.col("split") == "train", _fold(F.col("contract_id"))
    scored = None
    for k in range(N_FOLDS + 1):
        mine = train & (fold == k) if k < N_FOLDS else ~train
        model = fit_recurrent(table, len(features), config, schedule, learn=fold != k)
        part = model.states(table.filter(mine)).select("seat_id", F.col("step").alias("month"), "latent")
        scored = part if scored is None else scored.unionByName(part)
    names = latent_names(config.units)
    joined = months.select("seat_id", "contract_id", "month", "split", "label").join(squeezed, ["seat_id", "month"], "left").join(scored, ["seat_id", "month"], "left")
    return joined.withColumns({n: F.col("latent")[i] for i, n in enumerate(names)}).drop("latent")


def contract_sequences(seat_states: DataFrame, dates: DataFrame, cfg: ChurnConfig, units: int = RecurrentConfig.units) -> tuple[DataFrame, int]:
    """Stage 2 input: seat states pooled by contract and month, as sequences, and the number of features."""
    latent = ["squeezed_time", "squeezed_count", *latent_names(units)]
    features = [*pooled_names(latent), "n_seats"]
    return month_sequences(prep_pooled(seat_states, dates, latent, cfg), features, cfg), len(features)


def split_scores(model: RecurrentModel, table: DataFrame, split: str = "test") -> DataFrame:
    """``(label, score)`` of the live steps of one split."""
    return model.states(table.filter(F.col("split") == split)).select(F.col("label").cast("int").alias("label"), "score")
