"""Seat months, zero filling and pooling against plain loops."""

import random
from collections import defaultdict
from dataclasses import replace
from datetime import date, timedelta

import pytest

from pyspark.sql import functions as F

from seatwise.config import ChurnConfig
from seatwise.operators import grid, labels, months, pool, usage
from seatwise.plans import prep
from tests.test_labels import expected

ZERO = date(2020, 1, 1)
CFG = ChurnConfig(
    create_from=ZERO, create_to=date(2021, 1, 1), event_from=ZERO, event_to=date(2020, 12, 30),
    interest=("a", "b"), categories=("b", "a"),
)


def day(n):
    return ZERO + timedelta(days=n)


@pytest.fixture(scope="module")
def events():
    """(member, product, time, date, contract, seat, seat cancel, contract cancel, create), made by rule."""
    rng = random.Random(3)
    rows = []
    for seat in range(40):
        contract = f"c{seat % 7}"
        created = 0 if seat == 0 else rng.randrange(0, 300)
        cancelled = created + rng.randrange(0, 400)
        contract_cancel = 100 + 60 * (seat % 7)
        last = min(cancelled, 364)
        for _ in range(rng.choice([1, 2, 30])):
            on = rng.randrange(created, last + 1) if last >= created else created
            rows.append((f"m{seat}", rng.choice("ab"), rng.randrange(1, 50), day(on), contract, f"s{seat}",
                         day(cancelled), day(contract_cancel), day(created)))
    # The last day of a month is not in its sum; days 359 to 364 are in no month at all.
    for on in (0, 28, 29, 30, 58, 59, 358, 359, 360, 364):
        rows.append(("m99", "a", 1, day(on), "c1", "s99", day(380), day(200), day(0)))
    # Usage in days 360 to 364 only: the seat exists, with empty months.
    rows.append(("m98", "b", 5, day(362), "c2", "s98", day(500), day(450), day(300)))
    # One seat with two contracts.
    rows.append(("m97", "a", 2, day(10), "c5", "s97", day(200), day(450), day(1)))
    rows.append(("m97", "a", 3, day(12), "c3", "s97", day(190), day(450), day(2)))
    return rows


COLUMNS = (
    "member_id string, product_name string, session_time bigint, event_date date, contract_id string, "
    "seat_id string, seat_cancelled_date date, contract_cancelled_date date, create_date date"
)


@pytest.fixture(scope="module")
def dates(spark, events):
    return usage.with_day_zero(usage.seat_dates(spark.createDataFrame(events, COLUMNS), CFG), CFG)


@pytest.fixture(scope="module")
def truth(events):
    """Spans and day sums by plain loops."""
    seats, contracts, sums = {}, {}, defaultdict(lambda: defaultdict(int))
    for _, product, time, on, contract, seat, cancel, contract_cancel, create in events:
        d, create, cancel, contract_cancel = ((x - ZERO).days for x in (on, create, cancel, contract_cancel))
        old = seats.get(seat, (contract, create, cancel))
        seats[seat] = (min(old[0], contract), min(old[1], create), min(old[2], cancel))
        old = contracts.get(contract, (create, contract_cancel))
        contracts[contract] = (min(old[0], create), min(old[1], contract_cancel))
        sums[seat][d, f"time_{product}"] += time
        sums[seat][d, f"count_{product}"] += 1
    return seats, contracts, sums


def month_sum(sums, seat, feature, days):
    return sum(sums[seat].get((d, feature), 0) for d in days)


def test_feature_order():
    assert CFG.features == ["time_a", "time_b", "count_a", "count_b"]


def test_seat_and_contract_rollup(dates, truth):
    seats, contracts, _ = truth
    assert {r.seat_id: (r.contract_id, r.create_day, r.cancel_day) for r in labels.seat_rollup(dates).collect()} == seats
    assert {r.contract_id: (r.create_day, r.cancel_day) for r in labels.contract_rollup(dates).collect()} == contracts


def test_seat_month_usage(dates, truth):
    seats, _, sums = truth
    rows = months.seat_month_usage(dates, CFG, lifetime=True).collect()
    assert len(rows) == 12 * len(seats) == len({(r.seat_id, r.month) for r in rows})
    for r in rows:
        assert (r.contract_id, r.create_day, r.cancel_day) == seats[r.seat_id]
        for f in CFG.features:
            m = r.month
            assert r[f] == month_sum(sums, r.seat_id, f, range(30 * m, 30 * m + 29)), (r, f)
            assert r[f"life_{f}"] == month_sum(sums, r.seat_id, f, range(30 * m + 29)), (r, f)


def test_boundary_days(dates):
    rows = {r.month: r for r in months.seat_month_usage(dates, CFG, lifetime=True).filter("seat_id = 's99'").collect()}
    assert [rows[m].count_a for m in (0, 1, 11)] == [2, 2, 1]
    assert [rows[m].life_count_a for m in (0, 1, 2, 11)] == [2, 5, 6, 7]
    sparse = months.monthly_sum(usage.seat_days(dates, CFG), CFG).filter("seat_id = 's99'").collect()
    assert {r.month: r.count_a for r in sparse} == {0: 2, 1: 2, 11: 1}


def test_contract_months(dates, truth):
    seats, contracts, sums = truth
    rows = prep.prep_tabular_baseline(dates, CFG).collect()
    used = {c for c, _, _ in seats.values()}
    assert len(rows) == 12 * len(used)
    pooled = {(r.contract_id, r.month): r for r in prep.prep_pooled(months.seat_months(dates, CFG), dates, CFG.features, CFG).collect()}
    for r in rows:
        m, created, cancelled = r.month, *contracts[r.contract_id]
        label = expected(created // 30, cancelled // 30, 13)[m + 1]
        assert r.label == label and r.weight == {-1: 0, 0: 1, 1: 50}[label]
        live = [
            s for s, (c, a, b) in seats.items()
            if c == r.contract_id and expected(a // 30, b // 30, 13)[m + 1] != -1
        ]
        p = pooled[r.contract_id, m]
        if label == -1:
            assert all(r[f] is None for f in [*CFG.features, *CFG.lifetime_features, "n_seats"])
            assert p.n_seats is None and p.mean_time_a is None
            continue
        assert r.n_seats == (len(live) or None)
        assert p.n_seats == len(live)
        for f in CFG.features:
            values = [month_sum(sums, s, f, range(30 * m, 30 * m + 29)) for s in live]
            assert r[f] == sum(values)
            assert r[f"life_{f}"] == sum(month_sum(sums, s, f, range(30 * m + 29)) for s in live)
            assert p[f"max_{f}"] == max(values, default=0) and p[f"min_{f}"] == min(values, default=0)
            assert p[f"mean_{f}"] == pytest.approx(sum(values) / len(values) if values else 0)
            assert p[f"min_{f}"] <= p[f"mean_{f}"] + 1e-9 <= p[f"max_{f}"] + 2e-9


def test_zero_fill_life(dates, truth):
    seats, _, sums = truth
    spans = labels.seat_rollup(dates)
    filled = grid.zero_fill_life(usage.seat_days(dates, CFG), spans, CFG.features, CFG.horizon_days)
    got = defaultdict(dict)
    for r in filled.collect():
        got[r.seat_id][r.day] = r
    for seat, (_, created, cancelled) in seats.items():
        usage_days = {d for d, _ in sums[seat]}
        assert set(got[seat]) == set(range(created, min(cancelled, 364) + 1)) | usage_days
        for d, r in got[seat].items():
            assert all(r[f] == sums[seat].get((d, f), 0) for f in CFG.features)
    dense = grid.dense_days(usage.seat_days(dates, CFG), spans, CFG.features, CFG.horizon_days)
    assert dense.count() == 365 * len(seats)
    cells = {(r.seat_id, r.day): r for r in dense.filter("time_a is not null").collect()}
    assert set(cells) == {(seat, d) for seat, days in got.items() for d in days}
    assert all(cells[seat, d][f] == r[f] for seat, days in got.items() for d, r in days.items() for f in CFG.features)


def test_pool_presence(spark):
    df = spark.createDataFrame(
        [("c", 0, 1, 2), ("c", 0, None, None), ("c", 0, 0, None), ("c", 1, None, None)],
        "contract_id string, day int, x int, y int",
    )
    rows = {r.day: r for r in pool.pool_presence(df, ["x", "y"]).collect()}
    assert rows[0].mean_x == pytest.approx(2 / 3) and rows[0].mean_y == pytest.approx(1 / 3)
    assert (rows[0].max_x, rows[0].min_x, rows[0].n_seats) == (1, 0, 2)
    assert (rows[1].mean_x, rows[1].max_x, rows[1].n_seats) == (0, 0, -1)


def test_samples(spark, dates, truth, tmp_path):
    from seatwise.sources.samples import dense_tensor, explode_tensor, export_tensor, load_sample_columns

    seats, contracts, sums = truth
    export_tensor(prep.seat_samples(dates, CFG), str(tmp_path / "samples"))
    samples = load_sample_columns(spark, str(tmp_path / "samples"))
    rows = {r.seat_id: r for r in dense_tensor(samples, CFG).collect()}
    assert set(rows) == set(seats)
    for seat, (contract, created, cancelled) in seats.items():
        r = rows[seat]
        assert (r.contract_id, r.seat_create, r.seat_cancel) == (contract, created, cancelled)
        assert (r.contract_create, r.contract_cancel) == contracts[contract]
        assert r.label_seat_daily == expected(created, cancelled, 365)
        assert r.label_seat_monthly == expected(created // 30, cancelled // 30, 13)
        assert r.label_contract_monthly == expected(*(v // 30 for v in contracts[contract]), 13)
        days = {d for d, _ in sums[seat]}
        assert len(r.x) == 365
        for d, f in enumerate(r.x):
            assert f == ([sums[seat].get((d, k), 0) for k in CFG.features] if d in days else [-1] * 4)
    total = explode_tensor(samples).select(F.sum(F.col("f")[0])).first()[0]
    assert total == sum(v for s in sums.values() for (_, f), v in s.items() if f == "time_a")


def test_pinned_day_zero(dates):
    pinned = replace(CFG, day_zero=day(-30))
    df = usage.with_day_zero(dates.drop("day_zero"), pinned)
    first = {r.seat_id: r.create_day for r in labels.seat_rollup(df).collect()}
    plain = {r.seat_id: r.create_day for r in labels.seat_rollup(dates).collect()}
    assert first == {k: v + 30 for k, v in plain.items()}


def test_presence_from_spans(spark):
    spans = [(f"s{i}", f"c{i % 3}", a, b) for i, (a, b) in enumerate(
        [(0, 5), (3, None), (9, 20), (2, 2), (8, 4), (6, -1), (12, 15), (0, 9), (1, 10), (4, 11)])]
    df = spark.createDataFrame(spans, "seat_id string, contract_id string, create_day int, cancel_day int")
    n = 10
    cfg = replace(CFG, horizon_days=n)
    masked = grid.mask_by_label(labels.day_labels(df, cfg).withColumn("x", F.lit(0)), ["x"])
    slow = {(r.contract_id, r.day): r.asDict() for r in pool.pool_presence(masked, ["x"]).collect()}
    fast = {(r.contract_id, r.day): r.asDict() for r in pool.presence_from_spans(df, ["x"], n).collect()}
    assert slow == fast and len(fast) == 30
