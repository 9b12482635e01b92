"""Events laid out by bucket: the join equals all pairs, and the events stay where they are."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from seatwise.fixtures import STAR
from seatwise.operators.clean import dedup_rows
from seatwise.operators.layout import EventLayout, add_events, assigned_from_layout, join_laid_out, month_number
from tests.test_joins import frames, pairs, result, tables  # noqa: F401

CFG = replace(STAR, event_from=date(1995, 5, 1), event_to=date(1995, 12, 31))


def laid(frames, path, n, **limits):  # noqa: F811
    """The events in ``n`` batches, cut by time of day and member, so that months stay open."""
    layout = EventLayout(str(path), 8)
    events = frames[0]
    for b in range(n):
        part = events.filter(F.pmod(F.xxhash64("event_time", "product_name"), F.lit(n)) == b)
        add_events(layout, part.unionAll(part), b, **limits)
    return layout


@pytest.mark.parametrize("limits", [{}, {"share": 1e-3, "floor": 5}])
@pytest.mark.parametrize("n", [1, 3])
def test_layout_equals_all_pairs(frames, tables, tmp_path, n, limits):  # noqa: F811
    layout = laid(frames, tmp_path / "layout", n, **limits)
    assert result(join_laid_out(layout, frames[1], CFG)) == pairs(tables)


def test_copies_and_reruns(frames, tables, tmp_path):  # noqa: F811
    layout = laid(frames, tmp_path / "layout", 2, share=1e-3, floor=5)
    # All events again: nothing new, and a batch that runs twice replaces itself.
    for _ in range(2):
        assert add_events(layout, frames[0], 2).count() == 0
    assert add_events(layout, frames[0].filter(F.pmod(F.xxhash64("event_time", "product_name"), F.lit(2)) == 1), 1).count() > 0
    assert result(join_laid_out(layout, frames[1], CFG)) == pairs(tables)


def test_events_are_not_shuffled(frames, tables, tmp_path, spark):  # noqa: F811
    layout = laid(frames, tmp_path / "layout", 2)
    june = month_number(F.lit(date(1995, 6, 1)))
    june = spark.range(1).select(june.alias("m")).first()["m"]
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_laid_out(layout, frames[1], CFG, months=[june])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        found = result(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert found == {k: n for k, n in pairs(tables).items() if k[0][1].month == 6}
    # The side of the events: from its scan up to the join there is no exchange.
    join = plan.index("SortMergeJoin")
    sides = plan[join:].split("+- ")
    scan = plan.index("events_") if "events_" in plan[join:] else plan.index("Bucketed: true")
    between = plan[join:scan]
    assert "Bucketed: true" in plan and "Exchange" not in between, plan
    assert f"month#" in plan and "PartitionFilters" in plan and len(sides) > 1


def test_empty(frames, tmp_path):  # noqa: F811
    layout = EventLayout(str(tmp_path / "layout"), 4)
    assert add_events(layout, frames[0].limit(0), 0).count() == 0
    assert assigned_from_layout(layout, frames[1], CFG).count() == 0
    add_events(layout, frames[0], 1)
    assert assigned_from_layout(layout, frames[1].limit(0), CFG).count() == 0
    twice = frames[1].unionAll(frames[1])
    plain = assigned_from_layout(layout, frames[1], replace(CFG, dedup_per_seat=True)).count()
    assert assigned_from_layout(layout, twice, replace(CFG, dedup_per_seat=True)).count() == plain


def test_events_do_not_pass_through_the_driver(frames, tmp_path, spark, monkeypatch):  # noqa: F811
    """However small the files of the events are, neither the join nor the search for copies broadcasts them."""
    layout = laid(frames, tmp_path / "layout", 2)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1_000_000
    joined = join_laid_out(layout, frames[1], CFG)
    result(joined)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    scans = [part for part in plan.split("BroadcastExchange")[1:] if "Bucketed: true" in part.split("SortMergeJoin")[0]]
    assert "SortMergeJoin" in plan and not scans, plan

def test_rows_are_dealt_before_copies_are_removed(spark):
    """No task holds the distinct rows of all that it read before the shuffle; names may be equal or hold dots."""
    rows = spark.createDataFrame([(1, None), (1, None), (2, "x"), (1, "x"), (2, "x")], "a int, b string").toDF("a.b", "a.b")
    found = dedup_rows(rows)
    assert found.columns == rows.columns
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "x"), (1, None), (2, "x")]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("Exchange"), plan  # both lie above the exchange
