"""Late events and corrected sessions: whatever the order of arrivals, the features are those of one run over all data."""

from dataclasses import replace
from datetime import datetime, timedelta
import random

import pytest
from pyspark.sql import functions as F

from seatwise.fixtures import DAY_ONE, STAR
from seatwise.plans.prep import assigned_from_raw, dated_usage, prep_sequence_baseline
from seatwise.streaming.upkeep import Upkeep, compact, kept_dates, kept_features, run_batch, session_changes, state_at

CFG = replace(STAR, day_zero=DAY_ONE, interest=("anvil", "bolt"), categories=("anvil", "bolt"))
START = datetime(1995, 5, 1)
USAGE = "member_id string, event_time timestamp_ntz, product_name string, session_time bigint"
RAW = (
    "member_id string, contract_id string, seat_id string, start_time timestamp_ntz, end_time timestamp_ntz, "
    "seat_created_date timestamp_ntz, seat_cancelled_date timestamp_ntz, contract_created_date timestamp_ntz, contract_cancelled_date timestamp_ntz"
)


def day(n):
    return START + timedelta(days=n)


def session(member, contract, seat, first, last, cancel):
    return (member, contract, seat, day(first), day(last), day(2), day(cancel), day(1), day(320))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    events = [
        (rng.choice(["m0", "m0", "m1", "m2", "m3", None]), day(rng.randrange(0, 200)), rng.choice(["an", "bo", "zz"]), rng.choice([1, 2, None]))
        for _ in range(400)
    ]
    events += [("alone", day(5), "an", 1), *events[:20]]
    old = [
        session("m0", "c0", "s0", 3, 150, 200), session("m1", "c0", "s1", 3, 90, 160), session("m2", "c1", "s2", 10, 60, 300),
        session("m3", "old", "s3", 3, 100, 250), session("alone", "gone", "s4", 3, 100, 250),
    ]
    new = [
        # Shorter; another member after it; cancelled earlier.
        session("m0", "c0", "s0", 3, 80, 120), session("m3", "c0", "s0", 81, 110, 120),
        # As it was, twice; longer; moved to another contract; a new seat; "alone" has no session any more.
        old[1], old[1], session("m2", "c1", "s2", 3, 190, 300), session("m3", "c1", "s3", 3, 100, 250), session("m1", "c2", "s5", 100, 199, 260),
    ]
    return events, old, new


@pytest.fixture(scope="module")
def frames(spark, tables):
    events, old, new = tables
    taxonomy = spark.createDataFrame([("an", "anvil"), ("bo", "bolt")], "alias string, category string")
    return spark.createDataFrame(events, USAGE), spark.createDataFrame(old, RAW), spark.createDataFrame(new, RAW), taxonomy


@pytest.fixture(scope="module")
def whole(frames):
    """Dates and features of one run over all events and the last sessions."""
    usage, _, new, taxonomy = frames
    dates = dated_usage(assigned_from_raw(new, usage, taxonomy, CFG), CFG)
    return rows(dates), rows(prep_sequence_baseline(dates, CFG))


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def part(usage, n, i):
    return usage.filter(F.pmod(F.xxhash64("member_id", F.month("event_time")), F.lit(n)) == i)


def last_dates(spark, up, batch):
    return rows(kept_dates(state_at(spark, up, batch), CFG))


def test_events_late_sessions_corrected(spark, frames, whole, tmp_path):
    """Half of the events under the old sessions, then the correction with the rest."""
    usage, old, new, taxonomy = frames
    up = Upkeep(str(tmp_path), CFG, 4, share=1e-3, floor=20)
    run_batch(spark, up, 0, part(usage, 2, 0), taxonomy, old)
    run_batch(spark, up, 1, part(usage, 2, 1), taxonomy, new)
    assert (last_dates(spark, up, 1), rows(kept_features(spark, up))) == whole
    # A batch that runs again replaces itself.
    run_batch(spark, up, 1, part(usage, 2, 1), taxonomy, new)
    assert (last_dates(spark, up, 1), rows(kept_features(spark, up))) == whole
    # Nothing new, in copies and as None; a merged state changes nothing.
    compact(spark, up, 1)
    run_batch(spark, up, 2, usage, taxonomy, None)
    assert (last_dates(spark, up, 2), rows(kept_features(spark, up))) == whole
    assert spark.read.parquet(up.folder("changes", 2)).count() == 0


def test_correction_before_and_after_the_events(spark, frames, whole, tmp_path):
    """The right sessions, then all events, then a wrong correction that is taken back."""
    usage, old, new, taxonomy = frames
    up = Upkeep(str(tmp_path), CFG, 4)
    run_batch(spark, up, 0, None, taxonomy, new)
    assert kept_features(spark, up).count() == 0
    run_batch(spark, up, 1, usage, taxonomy, None)
    assert (last_dates(spark, up, 1), rows(kept_features(spark, up))) == whole
    run_batch(spark, up, 2, None, taxonomy, old)
    held = {r["contract_id"] for r in kept_features(spark, up).collect()}
    assert {"gone", "old"} <= held and "c2" not in held
    run_batch(spark, up, 3, None, taxonomy, new)
    assert (last_dates(spark, up, 3), rows(kept_features(spark, up))) == whole


def test_session_changes(spark):
    old = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "x string, y int")
    new = spark.createDataFrame([("a", 1), ("b", None), ("c", 4)], "x string, y int")
    assert sorted(map(tuple, session_changes(old, new).collect())) == [("c", 3, -1), ("c", 4, 1)]
    assert session_changes(new, new).count() == 0 and session_changes(None, new).count() == 3


def test_refused():
    with pytest.raises(ValueError):
        Upkeep("x", STAR, 4)
    with pytest.raises(ValueError):
        Upkeep("x", replace(CFG, dedup_per_seat=True), 4)
