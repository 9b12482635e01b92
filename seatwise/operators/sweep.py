"""Interval join by a sweep over time: the cost is rows plus matches, however many sessions a member has."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from seatwise.functions.dates import time_bucket
from seatwise.operators.skew import HOT_FLOOR, HOT_SHARE, hot_keys

CELL = ["_member", "_bucket", "_event_part", "_session_part"]
# Pairs in one batch of output.
MAX_PAIRS = 20_000


def _dealt(df: DataFrame, hot: DataFrame, own: str, hashed: list[str]) -> DataFrame:
    """Each row in one of its key's parts."""
    parts = df.join(F.broadcast(hot), ["_member", "_bucket"], "left")
    return parts.withColumn(own, F.pmod(F.xxhash64(*hashed), F.coalesce("n_salts", F.lit(1))).cast("int")).drop("n_salts")


def _copied(df: DataFrame, hot: DataFrame, other: str) -> DataFrame:
    """Each row in all parts of the other side."""
    parts = df.join(F.broadcast(hot), ["_member", "_bucket"], "left")
    return parts.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce("n_salts", F.lit(1)) - 1))).drop("n_salts")


def sweep_marks(
    usage: DataFrame, assignments: DataFrame, bucket_days: int, window: tuple[date, date] | None = None, share: float = HOT_SHARE, floor: int = HOT_FLOOR
) -> DataFrame:
    """Events and session starts by cell, with ``_at``, ``_end``, ``_event`` and ``_session``.

    A cell is a member, a time bucket, and a part of the events and one of the sessions. Both sides of a hot (member,
    bucket) are cut by a hash of the row, each side is copied to the other's parts, so an event and a session meet in one
    cell. The hot keys of either side are fewer than 1 / ``share``, which bounds the broadcasts.
    """
    events = usage.filter(F.col("event_time").isNotNull() & F.col("member_id").isNotNull())
    if window is not None:
        events = events.filter(F.col("event_date").between(*map(F.lit, window)))
    moment = usage.schema["event_time"].dataType
    events = events.select(
        F.col("member_id").alias("_member"), time_bucket(F.to_date("event_time"), bucket_days).alias("_bucket"),
        F.col("event_time").alias("_at"), F.struct(*usage.columns).alias("_event"),
    )
    first, last = (usage.agg(f("event_time")).scalar() for f in (F.min, F.max)) if window is None else (
        F.lit(window[0]).cast(moment), (F.lit(window[1]) + F.expr("interval 1 day")).cast(moment)
    )
    # An event is at or after midnight of a day exactly when its date is not before that day.
    start = F.greatest("start_time", F.col("create_date").cast(moment))
    whole = F.col("member_id").isNotNull() & F.col("start_time").isNotNull() & F.col("end_time").isNotNull() & F.col("create_date").isNotNull()
    begin, end = F.greatest(start, first), F.least(F.col("end_time"), last)
    sessions = assignments.filter(whole & (begin <= end)).select(
        F.col("member_id").alias("_member"),
        F.explode(F.sequence(time_bucket(F.to_date(begin), bucket_days), time_bucket(F.to_date(end), bucket_days))).alias("_bucket"),
        start.cast(moment).alias("_at"), F.col("end_time").cast(moment).alias("_end"),
        F.struct(*[c for c in assignments.columns if c != "member_id"]).alias("_session"),
    )
    key = ["_member", "_bucket"]
    hot_events, hot_sessions = (hot_keys(df, key, share, floor) for df in (events, sessions))
    events = _copied(_dealt(events, hot_events, "_event_part", ["_event"]), hot_sessions, "_session_part")
    sessions = _copied(_dealt(sessions, hot_sessions, "_session_part", ["_session"]), hot_events, "_event_part")
    return sessions.unionByName(events, allowMissingColumns=True).select(*CELL, "_at", "_end", "_event", "_session")


def pairs(events_before: np.ndarray, events_until: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(session, event)`` places in pieces of at most ``limit``; session i has the events from ``events_before[i]`` up to
    ``events_until[i]``."""
    counts = np.maximum(events_until - events_before, 0)
    ends = np.cumsum(counts)
    for first in range(0, int(ends[-1]) if len(ends) else 0, limit):
        place = np.arange(first, min(first + limit, int(ends[-1])))
        session = np.searchsorted(ends, place, "right")
        yield session, events_before[session] + place - (ends - counts)[session]


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows in order of cell and time, starts before events of the same moment.

    A session matches a run of the events that follow it, found by search instead of comparison. What is held is one
    batch and the sessions of the last cell that are still open.
    """
    open_cell, open_end, open_session = None, np.zeros(0, np.int64), None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        changes = np.zeros(n, bool)
        for c in CELL:
            column = batch.column(c)
            changes[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        run = np.cumsum(changes)
        at = batch.column("_at").cast(pa.int64()).to_numpy()
        is_event = batch.column("_event").is_valid().to_numpy(zero_copy_only=False)
        event_rows, start_rows = np.flatnonzero(is_event), np.flatnonzero(~is_event)
        end = batch.column("_end").cast(pa.int64()).fill_null(0).to_numpy()[start_rows]
        session = batch.column("_session").take(pa.array(start_rows))
        before, session_run = np.cumsum(is_event)[start_rows], run[start_rows]
        if open_session is not None and open_cell == tuple(batch.column(c)[0].as_py() for c in CELL):
            k = len(open_end)
            end, session = np.concatenate([open_end, end]), pa.concat_arrays([open_session, session])
            before, session_run = np.concatenate([np.zeros(k, np.int64), before]), np.concatenate([np.zeros(k, np.int64), session_run])
        times = np.unique(at[event_rows])
        wide = len(times) + 1
        order = run[event_rows] * wide + np.searchsorted(times, at[event_rows])
        until = np.searchsorted(order, session_run * wide + np.searchsorted(times, end, "right") - 1, "right")
        events = batch.column("_event").take(pa.array(event_rows))
        for s, e in pairs(before, until, MAX_PAIRS):
            yield pa.RecordBatch.from_arrays([events.take(pa.array(e)), session.take(pa.array(s))], ["_event", "_session"])
        last = run[-1]
        kept = np.flatnonzero((session_run == last) & (end >= at[-1]))
        open_cell = tuple(batch.column(c)[n - 1].as_py() for c in CELL)
        open_end, open_session = end[kept], session.take(pa.array(kept))


def interval_join_sweep(
    usage: DataFrame, assignments: DataFrame, bucket_days: int, window: tuple[date, date] | None = None, share: float = HOT_SHARE, floor: int = HOT_FLOOR
) -> DataFrame:
    """``interval_join``, for members with very many sessions: one shuffle of both sides, sorted by time, then a sweep.

    Copies of events and of sessions count each for itself. NULL members, times and creation dates match nothing; a session
    that ends before it starts has no events.
    """
    marks = sweep_marks(usage, assignments, bucket_days, window, share, floor)
    ordered = marks.repartition(*CELL).sortWithinPartitions(*CELL, "_at", F.col("_event").isNotNull())
    event, session = (marks.schema[c].dataType.simpleString() for c in ("_event", "_session"))
    return ordered.mapInArrow(sweep, f"_event {event}, _session {session}").select("_event.*", "_session.*")
