"""Figures taken along against the checks in a pass of their own, and merged sketches against exact counts."""

import pytest
from pyspark.sql import functions as F

from seatwise.operators import observed, quality
from seatwise.workspace import new_path

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def cells(spark):
    data = [(i % 40, None if i % 7 == 0 else float(i), None if i % 3 else 1.0, [-1, 0, 1, None, 5][i % 5]) for i in range(500)]
    return spark.createDataFrame(data, "k int, a double, b double, label int").repartition(5)


def figures():
    return observed.mask_figures(FEATURES) | observed.label_figures() | observed.distinct_figures(["k"])


def test_same_counts_as_the_checks(cells):
    table, found = observed.observed_stage(cells, "cells", figures())
    expected = quality.check_mask_consistency(cells, FEATURES).first().asDict()
    assert {n: found[n] for n in expected} == expected and table.count() == 500
    counts = {r["label"]: r["n"] for r in quality.label_histogram(cells).collect()}
    assert (found["n_label_m1"], found["n_label_0"], found["n_label_1"]) == (counts[-1], counts[0], counts[1])
    assert found["n_label_other"] == counts[None] + counts[5]
    assert found["n_k"] == 40
    dates = cells.selectExpr("date_add(date'2024-01-10', k % 3) as event_date", "if(k = 1, null, date'2024-01-11') as create_date")
    assert observed.observed_stage(dates, "dates", observed.create_figures())[1] == quality.check_event_after_create(dates).first().asDict()


def test_no_second_scan(spark, cells):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    observed.observed_stage(cells.mapInArrow(count, cells.schema), "cells", figures())
    assert seen.value == 500


def test_empty_table(cells):
    found = observed.observed_stage(cells.limit(0), "cells", figures())[1]
    assert set(found.values()) == {0}


def test_sketches_merge_over_months_and_a_month_is_replaced(spark):
    """Values overlap between the months; error stated 0.8 %, five times that allowed."""
    df = spark.range(60_000).selectExpr("cast(id % 3 as string) as month", "id % 25000 as wide", "id % 700 as narrow", "cast(null as string) as empty")
    columns, path = ["wide", "narrow", "empty"], new_path(spark, "sketches")
    observed.store_sketches(observed.month_sketches(df.filter("month < 2"), columns, F.col("month")), path)
    observed.store_sketches(observed.month_sketches(df.filter("month = 2").unionAll(df.filter("month = 1")), columns, F.col("month")), path)
    exact = quality.distinct_counts(df, columns).first()
    found = observed.stored_counts(spark, path, columns).first()
    assert found.n_rows == exact.n_rows and found.n_empty == 0 and abs(found.n_narrow - 700) <= 2
    assert found.n_wide == pytest.approx(exact.n_wide, rel=0.04)
    part = observed.stored_counts(spark, path, columns, "1", "1").first()
    assert part.n_rows == 20_000 and part.n_wide == pytest.approx(df.filter("month = 1").select("wide").distinct().count(), rel=0.04)
    assert observed.stored_counts(spark, path, columns, "9").first().asDict() == {"n_rows": 0, "n_wide": 0, "n_narrow": 0, "n_empty": 0}
