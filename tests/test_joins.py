"""Interval joins and split joins against all pairs, with one member holding most rows."""

import random
from collections import Counter
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest

from seatwise.fixtures import STAR
from seatwise.operators import assign, clean
from seatwise.operators.skew import broadcast_if_small, hot_keys, skew_join

START = datetime(1995, 5, 1)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    events = set()
    for _ in range(600):
        member = "m0" if rng.random() < 0.5 else f"m{rng.randrange(1, 20)}"
        at = START + timedelta(days=rng.randrange(0, 120), seconds=rng.choice([0, 1, 43200, 86399]))
        events.add((member, at, rng.choice("ab"), rng.randrange(3)))
    events |= {("m0", START + timedelta(days=10), "a", 1), (None, START, "a", 1)}
    sessions = []
    for seat in range(60):
        member = "m0" if seat % 3 == 0 else f"m{rng.randrange(1, 20)}"
        first = START + timedelta(days=rng.randrange(-40, 120), seconds=rng.choice([0, 1, 43200]))
        length = rng.choice([-5, 0, 1, 7, 35, 400])
        last = first + timedelta(days=length)
        sessions.append((member, f"c{seat % 4}", f"s{seat}", first, last, date(1996, 1, 1), date(1997, 1, 1),
                         (first + timedelta(days=rng.choice([-3, 0, 5]))).date()))
    # Bounds included at both ends; open-ended session; no end; no creation date.
    sessions.append(("m0", "c0", "exact", START + timedelta(days=10), START + timedelta(days=10), None, None, START.date()))
    sessions.append(("m0", "c0", "open", START, datetime(9999, 12, 31), None, None, START.date()))
    sessions.append(("m0", "c0", "no end", START, None, None, None, START.date()))
    sessions.append(("m0", "c0", "no creation", START, datetime(1999, 1, 1), None, None, None))
    return list(events), sessions


@pytest.fixture(scope="module")
def frames(spark, tables):
    events = spark.createDataFrame(tables[0], "member_id string, event_time timestamp_ntz, product_name string, session_time int")
    sessions = spark.createDataFrame(
        tables[1],
        "member_id string, contract_id string, seat_id string, start_time timestamp_ntz, end_time timestamp_ntz, "
        "seat_cancelled_date date, contract_cancelled_date date, create_date date",
    )
    return events.selectExpr("*", "cast(event_time as date) as event_date"), sessions


def pairs(tables):
    return Counter(
        (e, s[2])
        for e in tables[0]
        for s in tables[1]
        if e[0] == s[0] and s[7] and e[1].date() >= s[7] and s[4] and s[3] <= e[1] <= s[4]
    )


def result(df):
    return Counter(((r.member_id, r.event_time, r.product_name, r.session_time), r.seat_id) for r in df.collect())


def test_interval_join_is_all_pairs(frames, tables):
    assert result(assign.interval_join(*frames)) == pairs(tables)
    assert any(seat == "exact" for _, seat in pairs(tables))


@pytest.mark.parametrize("bucket_days", [1, 7, 30, 1000])
@pytest.mark.parametrize("floor", [3, 10**6])
def test_bucketed_equals_plain(frames, tables, bucket_days, floor):
    df = assign.interval_join_bucketed(*frames, bucket_days, share=1e-9, floor=floor)
    assert result(df) == pairs(tables)


def test_bucketed_small_table_and_window(frames, tables):
    window = (date(1995, 5, 1), date(1995, 12, 31))
    assert result(assign.interval_join_bucketed(*frames, 30, window, distinct=True)) == pairs(tables)


def test_salting_really_splits(frames):
    hot = {(r.member_id, r.n_salts) for r in hot_keys(frames[0], ["member_id"], share=1e-9, floor=50).collect()}
    assert len(hot) == 1 and next(iter(hot))[0] == "m0" and next(iter(hot))[1] >= 4


def test_hot_keys_are_bounded(spark):
    df = spark.range(100_000).selectExpr("id % 5000 as k").unionAll(spark.range(50_000).selectExpr("0L as k"))
    share = 1 / 50
    assert hot_keys(df, ["k"], share=share, floor=1).count() < 1 / share


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_skew_join_equals_plain(spark, how):
    facts = spark.range(2000).selectExpr("case when id % 2 = 0 then 0 else id % 40 end as k", "id as v")
    facts = facts.unionAll(spark.sql("select cast(null as bigint) as k, -1L as v"))
    dims = spark.range(0, 30).selectExpr("id as k", "id * 10 as w").unionAll(spark.sql("select 0L as k, 7L as w"))
    split = skew_join(facts, dims, ["k"], ["v"], how, share=1e-9, floor=100)
    plain = facts.join(dims, "k", how)
    assert split.columns == plain.columns
    assert Counter(split.collect()) == Counter(plain.collect())


def test_dedup_per_seat(spark, frames, tables):
    events, sessions = frames
    cfg = replace(STAR, event_to=date(1996, 12, 31))
    doubled = sessions.unionAll(sessions.filter("seat_id = 'open'"))
    n = {flag: assign.assigned_usage(events, doubled, replace(cfg, dedup_per_seat=flag)).count() for flag in (False, True)}
    extra = sum(v for (_, seat), v in pairs(tables).items() if seat == "open")
    assert n[True] == pairs(tables).total() and n[False] == n[True] + extra


def test_normalize_and_filter(spark):
    usage = spark.createDataFrame(
        [("m", START, "X 1", 5), ("m", START, "X one", 5), ("m", START, "x 1", 5), ("m", START, None, 5), ("m", START, "Y", 1)],
        "member_id string, event_time timestamp_ntz, product_name string, session_time int",
    )
    taxonomy = spark.createDataFrame([("X 1", "X"), ("X one", "X"), ("Y", "Y")], "alias string, category string")
    named = assign.normalize_product(usage, taxonomy)
    assert Counter(r.product_name for r in named.collect()) == {"X": 2, "NA": 2, "Y": 1}
    assert assign.filter_products(named, ["X", "y"]).count() == 2
    assert assign.filter_products(named, ["NA"]).count() == 2
    # Two aliases with the same time and duration are one event.
    cfg = replace(STAR, interest=("X",))
    assert assign.prepare_usage(usage, taxonomy, cfg).distinct().count() == 1
    assert [r.category for r in assign.validate_interest(taxonomy, ["X", "y"]).collect()] == ["y"]


def test_large_taxonomy_is_not_broadcast(spark, monkeypatch):
    big = spark.range(50).selectExpr("cast(id as string) as alias", "'c' as category")
    assert broadcast_if_small(big, 10) is big
    monkeypatch.setattr(assign, "broadcast_if_small", lambda df: df)
    usage = spark.createDataFrame(
        [("m", START, "3", 5), ("m", START, "99", 5)],
        "member_id string, event_time timestamp_ntz, product_name string, session_time int",
    )
    assert sorted(r.product_name for r in assign.normalize_product(usage, big).collect()) == ["NA", "c"]


def test_clean_assignments(spark):
    ts = "timestamp_ntz"
    raw = spark.createDataFrame(
        [
            ("m1", "c", "keep", "1995-06-01", "1995-07-01", "1995-05-02", "1995-07-01", "1995-05-01", None),
            ("m1", "c", "keep", "1995-06-01", "1995-07-01", "1995-05-02", "1995-07-01", "1995-05-01", None),
            ("GUID_IS_NULL_FOR_THE_ROW", "c", "nobody", "1995-06-01", "1995-07-01", "1995-05-02", "1995-08-01", "1995-05-01", None),
            (None, "c", "no member", "1995-06-01", "1995-07-01", "1995-05-02", "1995-08-01", "1995-05-01", None),
            ("m1", "c", "past cancel", "1995-06-01", "1995-07-02", "1995-05-02", "1995-07-01", "1995-05-01", None),
            ("m1", "c", "no cancel", "1995-06-01", "1995-07-01", "1995-05-02", None, "1995-05-01", None),
            ("m1", "c", "too early", "1995-06-01", "1995-07-01", "1995-04-30", "1995-08-01", None, None),
            ("m1", "c", "first day", "1995-06-01", "1995-07-01", "1995-04-30", "1995-08-01", "1995-05-01", None),
            ("m1", "c", "last day", "1996-06-01", "1996-07-01", None, "1996-08-01", "1996-05-29", "1996-09-01"),
            ("m1", "c", "too late", "1996-06-01", "1996-07-01", "1996-05-30", "1996-08-01", "1996-05-29", None),
        ],
        ", ".join(f"{c} string" for c in clean.ASSIGNMENT_COLUMNS),
    )
    raw = raw.withColumns({c: raw[c].cast(ts) for c in clean.ASSIGNMENT_COLUMNS[3:]})
    rows = {r.seat_id: r for r in clean.clean_assignments(raw, STAR).collect()}
    assert set(rows) == {"keep", "first day", "last day"}
    assert rows["keep"].create_date == date(1995, 5, 2)
    assert rows["last day"].create_date == date(1996, 5, 29) and rows["last day"].contract_cancelled_date == date(1996, 9, 1)
    dirty = spark.createDataFrame([("1995-05-01",), ("no date",)], "d string")
    assert {r.d for r in clean.cast_dates(dirty, ["d"]).collect()} == {date(1995, 5, 1), None}


def test_one_shuffle_of_the_events(spark, tmp_path):
    """Copies are removed and sessions joined after a single exchange of the events."""
    events = spark.range(500).selectExpr(
        "concat('m', id % 7) as member_id", "timestamp_ntz'1995-06-01 00:00:00' + make_dt_interval(id % 50) as event_time",
        "'a x' as product_name", "id % 3 as session_time",
    )
    events.unionAll(events).write.parquet(str(tmp_path / "events"))
    day = "timestamp_ntz'1995-05-01 00:00:00'"
    sessions = spark.range(7).selectExpr(
        "concat('m', id) as member_id", "concat('c', id) as contract_id", "concat('s', id) as seat_id", f"{day} as start_time",
        f"{day} + make_dt_interval(200) as end_time", f"date({day}) as create_date", f"date({day}) as seat_cancelled_date", f"date({day}) as contract_cancelled_date",
    )
    sessions.write.parquet(str(tmp_path / "sessions"))
    taxonomy = spark.createDataFrame([("a x", "anvil")], "alias string, category string")
    prepared = assign.prepare_usage(spark.read.parquet(str(tmp_path / "events")), taxonomy, STAR)
    got = assign.assigned_usage(prepared, spark.read.parquet(str(tmp_path / "sessions")), STAR)
    assert got.count() == events.distinct().count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("== Initial Plan ==")[-1].split("\n") if "Exchange hashpartitioning" in x]
    assert not any("event_time" in x for x in exchanges)
    assert sum("_salt" in x for x in exchanges) == 2
