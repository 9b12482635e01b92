"""The sweep against all pairs, across batches, with both sides of a key split."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seatwise.operators import assign
from seatwise.operators.sweep import CELL, interval_join_sweep, pairs as pieces, sweep_marks
from tests.test_joins import frames, pairs, result, tables  # noqa: F401


@pytest.mark.parametrize("bucket_days", [1, 30, 1000])
@pytest.mark.parametrize("floor", [3, 10**6])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_sweep_equals_all_pairs(spark, frames, tables, bucket_days, floor, batch):  # noqa: F811
    """Small batches cut cells, so that sessions stay open from one batch to the next."""
    with spark_setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", batch):
        assert result(interval_join_sweep(*frames, bucket_days, share=1e-9, floor=floor)) == pairs(tables)


def test_window_copies_and_columns(spark, frames, tables):  # noqa: F811
    window = (date(1995, 5, 1), date(1995, 12, 31))
    plain = assign.interval_join(*frames)
    found = interval_join_sweep(*frames, 30, window)
    assert result(found) == pairs(tables) and found.columns == plain.columns and found.schema.simpleString() == plain.schema.simpleString()
    narrow = (date(1995, 5, 10), date(1995, 5, 20))
    inside = frames[0].filter(F.col("event_date").between(*map(F.lit, narrow)))
    assert result(interval_join_sweep(*frames, 7, narrow)) == result(assign.interval_join(inside, frames[1]))
    twice = frames[0].unionAll(frames[0])
    assert result(interval_join_sweep(twice, frames[1], 30, share=1e-9, floor=3)) == result(assign.interval_join(twice, frames[1]))


def test_empty_sides(frames):  # noqa: F811
    for events, sessions in ((frames[0].limit(0), frames[1]), (frames[0], frames[1].limit(0))):
        assert interval_join_sweep(events, sessions, 30).count() == 0


def test_one_member_with_100000_sessions_is_spread(spark):
    rng = np.random.default_rng(4)
    start = rng.integers(0, 10 * 86400, 100_000)
    length, at = rng.integers(0, 120, 100_000), rng.integers(0, 10 * 86400, 5_000)
    sessions = pd.DataFrame({"member_id": "m", "seat_id": np.arange(100_000).astype(str), "s": start, "n": length})
    sessions = spark.createDataFrame(sessions).selectExpr(
        "member_id", "seat_id", "timestamp_ntz'1995-05-01' + make_interval(0,0,0,0,0,0,s) as start_time",
        "timestamp_ntz'1995-05-01' + make_interval(0,0,0,0,0,0,s + n) as end_time", "date'1995-01-01' as create_date",
    )
    events = spark.createDataFrame(pd.DataFrame({"member_id": "m", "t": at})).selectExpr("member_id", "timestamp_ntz'1995-05-01' + make_interval(0,0,0,0,0,0,t) as event_time")
    events = events.withColumn("event_date", F.to_date("event_time"))
    expected = int((np.searchsorted(np.sort(start), at, "right") - np.searchsorted(np.sort(start + length), at, "left")).sum())
    assert interval_join_sweep(events, sessions, 30, floor=10_000).count() == expected
    cells = sweep_marks(events, sessions, 30, floor=10_000).groupBy(*CELL).agg(F.count_if(F.col("_event").isNull()).alias("n")).collect()
    assert len(cells) >= 10 and max(c.n for c in cells) < 12_000


def test_pieces_are_bounded_and_whole():
    before, until = np.array([0, 3, 2]), np.array([4, 3, 9])
    found = list(pieces(before, until, 3))
    assert max(len(s) for s, _ in found) == 3
    assert [(int(s), int(e)) for a, b in found for s, e in zip(a, b)] == [(0, e) for e in range(4)] + [(2, e) for e in range(2, 9)]
    assert list(pieces(np.zeros(0, int), np.zeros(0, int), 3)) == []


class spark_setting:
    def __init__(self, spark, name, value):
        self.conf, self.name, self.value = spark.conf, name, value

    def __enter__(self):
        self.before = self.conf.get(self.name)
        self.conf.set(self.name, self.value)

    def __exit__(self, *_):
        self.conf.set(self.name, self.before)
