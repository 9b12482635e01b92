"""Labels, masks and weights on hand-made spans."""

import itertools

from pyspark.sql import functions as F

from seatwise.fixtures import STAR
from seatwise.functions.labels import label_array, label_at, label_weight
from seatwise.operators import labels


def expected(created, cancelled, n):
    """The rule, step by step: outside life -1, alive 0, the step of cancellation 1."""
    result = []
    for step in range(n):
        if cancelled is not None and cancelled < n and step == cancelled:
            result.append(1)
        elif step >= created and (cancelled is None or cancelled >= n or step < cancelled):
            result.append(0)
        else:
            result.append(-1)
    return result


def test_label_array_all_small_spans(spark):
    n = 6
    spans = list(itertools.product(range(-2, 9), [None, *range(-3, 10)]))
    df = spark.createDataFrame(spans, "created int, cancelled int")
    rows = df.withColumn("labels", label_array(F.col("created"), F.col("cancelled"), n)).collect()
    assert len(rows) == len(spans)
    for row in rows:
        assert row.labels == expected(row.created, row.cancelled, n), row
        assert row.labels.count(1) <= 1
    one = label_at(F.col("step"), F.col("created"), F.col("cancelled"), n)
    steps = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("label", one)
    for row in steps.collect():
        assert row.label == expected(row.created, row.cancelled, n)[row.step]


def test_hand_spans(spark):
    df = spark.createDataFrame(
        [
            ("normal", 10, 100),
            ("censored", 10, 400),
            ("cancelled in period 0", 3, 20),
            ("created late", 200, 390),
            ("cancelled on day 370", 0, 370),
            ("never cancelled", 40, None),
            ("cancelled before day 0", 5, -2),
            ("cancelled before creation", 100, 40),
        ],
        "id string, create_day int, cancel_day int",
    )
    rows = {r.id: r for r in labels.monthly_labels(labels.daily_labels(df, STAR), STAR).collect()}
    assert rows["normal"].label_monthly == [0, 0, 0, 1] + [-1] * 9
    assert rows["normal"].label_daily == [-1] * 10 + [0] * 90 + [1] + [-1] * 264
    assert rows["censored"].label_monthly == [0] * 13
    assert rows["censored"].label_daily[10:] == [0] * 355
    assert rows["cancelled in period 0"].label_monthly == [1] + [-1] * 12
    assert rows["created late"].label_monthly == [-1] * 6 + [0] * 7
    # The daily horizon ends before the monthly one: churn by month, censored by day.
    assert rows["cancelled on day 370"].label_monthly == [0] * 12 + [1]
    assert rows["cancelled on day 370"].label_daily == [0] * 365
    assert rows["never cancelled"].label_monthly == [-1] + [0] * 12
    assert rows["cancelled before day 0"].label_daily == [-1] * 365
    assert rows["cancelled before day 0"].label_monthly == [-1] * 13
    assert rows["cancelled before creation"].label_monthly == [-1, 1] + [-1] * 11

    # Month m is live iff period m + 1 is alive or churns: the month before creation is live,
    # the month of cancellation is masked.
    lead = labels.sample_weights(labels.lead_labels(labels.period_labels(df, STAR)), STAR)
    lead = {(r.id, r.month): r for r in lead.collect()}
    assert [lead["created late", m].label for m in range(12)] == [-1] * 5 + [0] * 7
    assert [lead["normal", m].label for m in range(12)] == [0, 0, 1] + [-1] * 9
    assert all(lead["cancelled in period 0", m].label == -1 for m in range(12))
    for row in lead.values():
        assert row.weight == {-1: 0.0, 0: 1.0, 1: 50.0}[row.label]


def test_weight_values(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,)], "label int")
    rows = df.withColumn("weight", label_weight(F.col("label"), 7)).collect()
    assert {r.label: r.weight for r in rows} == {-1: 0.0, 0: 1.0, 1: 7.0}


def test_expand_monthly_to_daily(spark):
    df = spark.createDataFrame([("c", 35, 70)], "contract_id string, create_day int, cancel_day int")
    days = labels.expand_monthly_to_daily(labels.period_labels(df, STAR), "contract_id", STAR).collect()
    assert sorted(r.day for r in days) == list(range(365))
    by_day = {r.day: (r.label, r.weight) for r in days}
    assert by_day[0] == (-1, 0) and by_day[30] == (0, 1) and by_day[60] == (1, 1) and by_day[90] == (-1, 0)
    assert all(v == (0, 0) for d, v in by_day.items() if d % 30)
