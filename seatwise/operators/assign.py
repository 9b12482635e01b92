"""Attribution of usage events to seats."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from seatwise.config import ChurnConfig
from seatwise.functions.dates import time_bucket
from seatwise.operators.clean import filter_date_range, project_columns
from seatwise.operators.skew import HOT_FLOOR, HOT_SHARE, broadcast_if_small, skew_join

USAGE_COLUMNS = ["member_id", "event_time", "product_name", "session_time"]


def normalize_product(usage: DataFrame, taxonomy: DataFrame, unknown: str = "NA") -> DataFrame:
    """Replace the raw product alias by its category; an alias nobody lists becomes ``unknown``.

    The taxonomy is broadcast if it is as small as taxonomies are; otherwise the join is split by alias.
    """
    aliases = taxonomy.select(F.col("alias").alias("product_name"), "category")
    small = broadcast_if_small(aliases)
    if small is aliases:
        joined = skew_join(usage, aliases, ["product_name"], ["member_id", "event_time"], "left")
    else:
        joined = usage.join(small, "product_name", "left")
    return joined.withColumn("product_name", F.coalesce("category", F.lit(unknown))).select(usage.columns)


def filter_products(usage: DataFrame, interest: Sequence[str]) -> DataFrame:
    """Keep the categories of interest. After ``normalize_product`` the filter moves to the taxonomy side."""
    return usage.filter(F.col("product_name").isin(list(interest)))


def validate_interest(taxonomy: DataFrame, interest: Sequence[str]) -> DataFrame:
    """Names of interest that no taxonomy category matches (matching is case-sensitive)."""
    names = taxonomy.sparkSession.createDataFrame([(n,) for n in interest], "category string")
    return names.join(taxonomy, "category", "left_anti")


def prepare_usage(raw: DataFrame, taxonomy: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Raw events → events of interest inside the event window, with their date; copies are still there.

    Without a shuffle, if the taxonomy is small: ``assigned_usage`` removes the copies in the shuffle of its join.
    """
    df = project_columns(raw, USAGE_COLUMNS)
    df = filter_date_range(df, "event_time", cfg.event_from, cfg.event_to)
    df = normalize_product(df, taxonomy, cfg.unknown_category)
    df = filter_products(df, cfg.interest)
    return df.withColumn("event_date", F.to_date("event_time"))


def in_session(column: Callable[[str], Column]) -> Column:
    """Whether an event lies in a session of its member: both ends count, days before the creation date do not."""
    return (
        (column("event_date") >= column("create_date"))
        & (column("event_time") >= column("start_time"))
        & (column("event_time") <= column("end_time"))
    )


def interval_join(usage: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every event with every session of its member that contains it (both ends included).

    An equi-join on the member with the ranges as residual condition. Within one member all events are
    compared with all sessions, so use ``interval_join_bucketed`` where members can be heavy.
    """
    on = (usage["member_id"] == assignments["member_id"]) & in_session(F.col)
    return usage.join(assignments, on, "inner").drop(assignments["member_id"])


def interval_join_bucketed(
    usage: DataFrame,
    assignments: DataFrame,
    bucket_days: int,
    window: tuple[date, date] | None = None,
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
    distinct: bool = False,
) -> DataFrame:
    """``interval_join`` on (member, time bucket), with hot pairs split further.

    An event lies in one bucket; a session is copied to each bucket it touches inside ``window``, the
    dates that events can have (taken from the events when not given). A member with a third of all
    events is thus spread over the buckets of the window, and each of its hot buckets over several parts.

    The events are read twice, once to count the hot keys. ``distinct`` removes copies of events in the same shuffle.
    """
    events = usage.withColumn("_bucket", time_bucket(F.col("event_date"), bucket_days))
    first_day = F.greatest(F.to_date("start_time"), "create_date")
    last_day = F.to_date("end_time")
    if window is None:
        first_event = usage.agg(F.min("event_date")).scalar()
        last_event = usage.agg(F.max("event_date")).scalar()
    else:
        first_event, last_event = F.lit(window[0]), F.lit(window[1])
        events = events.filter(F.col("event_date").between(first_event, last_event))
    sessions = (
        assignments.withColumn("_from", F.greatest(first_day, first_event))
        .withColumn("_to", F.least(last_day, last_event))
        .filter((F.col("_from") <= F.col("_to")) & (F.col("start_time") <= F.col("end_time")))
        .withColumn(
            "_bucket",
            F.explode(
                F.sequence(time_bucket(F.col("_from"), bucket_days), time_bucket(F.col("_to"), bucket_days))
            ),
        )
        .select(*assignments.columns, "_bucket")
    )
    spread = ["event_time", "product_name", "session_time"]
    return skew_join(
        events,
        sessions,
        ["member_id", "_bucket"],
        spread,
        condition=in_session(F.col),
        share=share,
        floor=floor,
        distinct=distinct,
    ).drop("_bucket")


def assigned_usage(events: DataFrame, assignments: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Prepared events and cleaned assignments → one row per distinct event and seat it was made on.

    One shuffle of the events serves both the removal of copies and the join.
    """
    window = (cfg.event_from, cfg.event_to)
    df = interval_join_bucketed(events, assignments, cfg.bucket_days, window, floor=cfg.hot_floor, distinct=True)
    if cfg.dedup_per_seat:
        df = df.dropDuplicates([*events.columns, "seat_id"])
    return df.drop("event_time", "start_time", "end_time")
