"""Features kept up to date: late events add to them, corrected sessions take back what the old ones gave.

The state is a sum. Every pair of an event and a session that contains it counts +1 when it comes into being and -1 when it
ceases, under the key of its seat, contract and day and the dates that the labels need. Sums do not depend on the order in
which pairs come and go, so any order of arrivals gives what one run over all data gives. The least dates, which a sum
cannot take back, are found on reading, among the keys that are left.

A run writes four folders, each by batch, and nothing else: new events (an ``EventLayout``), the sessions as they are now, the
changes of the state, and the features of the contracts that changed. A run that failed is started again under its number
and replaces its own rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from seatwise.config import ChurnConfig
from seatwise.operators.assign import prepare_usage
from seatwise.operators.clean import clean_assignments
from seatwise.operators.layout import EventLayout, add_events, batch_numbers, join_laid_out, touched_months
from seatwise.operators.skew import HOT_FLOOR, HOT_SHARE, skew_join
from seatwise.operators.usage import time_sums, with_day_zero
from seatwise.plans.prep import prep_sequence_baseline
from seatwise.workspace import stage

SPANS = ["create_date", "seat_cancelled_date", "contract_cancelled_date"]
KEY = ["seat_id", "contract_id", "event_date", *SPANS]


@dataclass(frozen=True)
class Upkeep:
    """Where the state lies, and what it is computed for.

    ``cfg.day_zero`` must be set: with a moving day 0 every late event could change all features. ``dedup_per_seat`` is refused,
    since what is distinct is no sum.
    """

    path: str
    cfg: ChurnConfig
    buckets: int
    share: float = HOT_SHARE
    floor: int = HOT_FLOOR

    def __post_init__(self) -> None:
        if self.cfg.day_zero is None:
            raise ValueError("features that are kept up to date need a fixed day_zero")
        if self.cfg.dedup_per_seat:
            raise ValueError("dedup_per_seat cannot be kept up to date by sums")

    @property
    def layout(self) -> EventLayout:
        return EventLayout(f"{self.path}/layout", self.buckets)

    def folder(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch={batch}"


def _read(spark: SparkSession, up: Upkeep, kind: str, batches: list[int]) -> DataFrame:
    folders = [up.folder(kind, b) for b in batches]
    return spark.read.option("basePath", f"{up.path}/{kind}").parquet(*folders)


def session_changes(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Sessions that differ between two tables of distinct sessions, with ``_sign``: 1 for new ones, -1 for those gone.

    Equal rows cancel out in one shuffle; NULL equals NULL.
    """
    signed = new.withColumn("_sign", F.lit(1))
    if old is not None:
        signed = signed.unionByName(old.withColumn("_sign", F.lit(-1)))
    changed = signed.groupBy(*new.columns).agg(F.sum("_sign").cast("int").alias("_sign"))
    return changed.filter(F.col("_sign") != 0)


def signed_sums(pairs: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Changes of the state by key: ``pairs`` of events and sessions with ``_sign``, summed as signed."""
    pairs = pairs.withColumn("session_time", F.coalesce("session_time", F.lit(0)) * F.col("_sign"))
    counts = [F.sum(F.when(F.col("product_name") == c, F.col("_sign")).otherwise(0)).cast("bigint").alias(f"count_{c}") for c in cfg.categories]
    return pairs.groupBy(*KEY).agg(*time_sums(cfg.categories), *counts, F.sum("_sign").cast("bigint").alias("n_pairs"))


def merged(changes: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """The state: changes added up, without the keys of which no pair is left."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in [*cfg.features, "n_pairs"]]
    return changes.groupBy(*KEY).agg(*sums).filter(F.col("n_pairs") != 0)


def kept_dates(state: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """``seat_dates`` with ``day_zero``, from the state."""
    dates = state.groupBy("seat_id", "contract_id", "event_date").agg(
        *[F.sum(f).cast("bigint").alias(f) for f in cfg.features], *[F.min(c).alias(c) for c in SPANS]
    )
    return with_day_zero(dates, cfg)


def changes_until(spark: SparkSession, up: Upkeep, batch: int) -> DataFrame:
    """Rows that add up to the state after ``batch``: the last merged state and the changes since."""
    bases = batch_numbers(spark, f"{up.path}/state", batch + 1)[-1:]
    since = [b for b in batch_numbers(spark, f"{up.path}/changes", batch + 1) if not bases or b > bases[0]]
    parts = [_read(spark, up, kind, batches).drop("batch") for kind, batches in (("state", bases), ("changes", since)) if batches]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def state_at(spark: SparkSession, up: Upkeep, batch: int) -> DataFrame:
    """The state after ``batch``."""
    return merged(changes_until(spark, up, batch), up.cfg)


def compact(spark: SparkSession, up: Upkeep, batch: int) -> None:
    """Write the state after ``batch``, so that later runs read it instead of all changes before. For between two runs."""
    stage(state_at(spark, up, batch), "state", up.folder("state", batch))


def affected(changes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(contracts, rows)``: the contracts whose features can differ after ``changes``, and those of ``rows`` that they need.

    A seat counts for its least contract, so a changed seat touches every contract that it is or was assigned to; and a contract
    needs all rows of all its seats. ``rows`` need not be merged: only what is returned has to be. Contracts with many seats
    are split.
    """
    seats = changes.select("seat_id").distinct()
    moved = rows.join(seats, "seat_id", "left_semi").select("contract_id")
    contracts = stage(changes.select("contract_id").unionByName(moved).distinct(), "changed_contracts")
    known = rows.filter(F.col("contract_id").isNotNull())
    members = skew_join(known, contracts, ["contract_id"], ["seat_id"], "left_semi").select("seat_id").distinct()
    return contracts, rows.join(members, "seat_id", "left_semi")


def run_batch(
    spark: SparkSession, up: Upkeep, batch: int, usage: DataFrame | None, taxonomy: DataFrame, assignment: DataFrame | None
) -> None:
    """Take in raw ``usage`` that has arrived and the whole raw ``assignment`` table as it is now; None: nothing new.

    New events meet the sessions as they are now; all earlier events meet only the sessions that changed, in the months
    that these touch, and are not shuffled for it. Batches are run one after another, in the order of their numbers, from 0.
    """
    cfg, layout = up.cfg, up.layout
    if usage is None:
        usage = spark.createDataFrame([], "member_id string, event_time timestamp_ntz, product_name string, session_time bigint")
    add_events(layout, prepare_usage(usage, taxonomy, cfg), batch, up.share, up.floor)

    before = batch_numbers(spark, f"{up.path}/sessions", batch)
    old = _read(spark, up, "sessions", before[-1:]).drop("batch") if before else None
    if assignment is not None:
        now = stage(clean_assignments(assignment, cfg), "sessions", up.folder("sessions", batch))
    elif old is not None:
        now = old
    else:
        raise ValueError("the first batch needs the assignment table")

    new_batch = F.col("batch") == batch
    pairs = join_laid_out(layout, now, cfg, new_batch).withColumn("_sign", F.lit(1))
    sums = signed_sums(pairs, cfg)
    if assignment is not None and batch_numbers(spark, f"{layout.path}/events", batch):
        changed = stage(session_changes(old, now), "changed_sessions")
        # One row for each month of the event window at most.
        months = [r["_month"] for r in touched_months(changed, cfg).select("_month").distinct().collect()]
        if months:
            again = join_laid_out(layout, changed, cfg, F.col("batch") < batch, months)
            sums = sums.unionByName(signed_sums(again, cfg))
    changes = stage(sums, "changes", up.folder("changes", batch))

    contracts, rows = affected(changes, changes_until(spark, up, batch))
    dates = stage(kept_dates(merged(rows, cfg), cfg), "changed_dates")
    months_now = prep_sequence_baseline(dates, cfg).join(contracts, "contract_id", "left_semi")
    stage(months_now, "features", up.folder("features", batch))
    # Written last: a batch counts once its contracts are named here.
    stage(contracts, "contracts", up.folder("contracts", batch))


def kept_features(spark: SparkSession, up: Upkeep) -> DataFrame:
    """``prep_sequence_baseline`` as it is after the last batch: of each contract, the rows of the last batch that changed it.

    A contract that lost its last pair was changed by that batch and has no rows in it, so it is gone.
    """
    done = batch_numbers(spark, f"{up.path}/contracts", 1 << 62)
    last = _read(spark, up, "contracts", done).groupBy("contract_id").agg(F.max("batch").alias("batch"))
    return _read(spark, up, "features", done).join(last, ["contract_id", "batch"], "left_semi").drop("batch")
