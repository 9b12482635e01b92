"""Inputs that the fixtures do not have: lives before day 0, short periods, odd weights, NULL and hot keys, stages."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from seatwise import workspace
from seatwise.fixtures import EVENTS, STAR
from seatwise.operators import evaluate, grid, labels, pool, skew
from seatwise.plans import models
from seatwise.sources import samples

SPANS = [("a", "c", -2, 5), ("b", "c", 1, 3), ("d", "c", -4, -1), ("e", "c", 3, None), ("f", "c", 6, 2), ("g", "c", 9, 12)]
SCHEMA = "seat_id string, contract_id string, create_day int, cancel_day int"


def alive(day, create, cancel, n=8):
    """By the label rule: not outside life."""
    if cancel is not None and cancel < n and day == cancel:
        return True
    return day >= create and (cancel is None or cancel >= n or day < cancel)


def test_presence_of_seats_created_before_day_zero(spark):
    spans = spark.createDataFrame(SPANS, SCHEMA)
    got = {r["day"]: r for r in pool.presence_from_spans(spans, ["x"], 8).collect()}
    for day in range(8):
        live = sum(alive(day, a, b) for _, _, a, b in SPANS)
        assert got[day]["n_seats"] == (live or -1)
        assert got[day]["mean_x"] == pytest.approx(live / len(SPANS)) and got[day]["max_x"] == float(live > 0)


def test_grid_stays_inside_the_horizon(spark):
    spans = spark.createDataFrame(SPANS, SCHEMA)
    days = spark.createDataFrame([("a", 0, 5), ("a", 7, 2), ("b", 2, 1), ("z", 4, 9)], "seat_id string, day int, x bigint")
    used = {("a", 0): 5, ("a", 7): 2, ("b", 2): 1, ("z", 4): 9}
    zero = {(s, d): 0 for s, _, a, b in SPANS for d in range(8) if a <= d <= (7 if b is None else b)}
    got = {(r["seat_id"], r["day"]): r["x"] for r in grid.zero_fill_life(days, spans, ["x"], 8).collect()}
    assert got == zero | used
    dense = {(r["seat_id"], r["day"]): r["x"] for r in grid.dense_days(days, spans, ["x"], 8).collect()}
    every = {(s, d): None for s, *_ in SPANS for d in range(8)}
    assert dense == every | zero | used


def test_days_are_spread_in_all_parts(spark):
    """Usage rows are few and days many, so parts must not be merged by the size of the usage."""
    spans = spark.range(64).select(F.col("id").cast("string").alias("seat_id"), F.lit(0).alias("create_day"), F.lit(7).alias("cancel_day"))
    days = spark.createDataFrame([("1", 3, 9)], "seat_id string, day int, x bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dense = grid.dense_days(days, spans, ["x"], 8)
    assert dense.count() == 64 * 8 and dense.rdd.getNumPartitions() == parts > 1


def test_days_past_the_last_period(spark):
    periods = spark.createDataFrame([("c", p, p % 2) for p in range(5)], "contract_id string, period int, label int")
    for n_periods in (5, 3):
        cfg = replace(EVENTS, n_periods=n_periods)
        got = labels.expand_monthly_to_daily(periods.filter(F.col("period") < n_periods), "contract_id", cfg).orderBy("day").collect()
        assert [r["day"] for r in got] == list(range(30))
        first = {5 * p: p % 2 for p in range(n_periods)}
        assert all((r["label"], r["weight"]) == ((first[r["day"]], 1) if r["day"] in first else (0, 0)) for r in got)


@pytest.mark.parametrize("weight", [0.0, 0.5, 2.7, None])
def test_perceptron_refuses_weights_that_are_not_whole(spark, weight):
    rows = [("train", 1.0, float(i % 2), 1.0) for i in range(6)] + [("train", 0.0, 0.0, weight)]
    df = spark.createDataFrame(rows, "split string, x double, label double, weight double")
    with pytest.raises(ValueError, match="whole"):
        models.fit_mlp(df, ["x"], hidden=(2,), iterations=2)


def test_any_product_counts_as_use(spark):
    last = STAR.count_features[-1]
    rows = [("c", m, *[0] * 13, 3 if m == 2 else 0, 0.0, 1.0) for m in range(5)]
    columns = [*STAR.time_features, *STAR.count_features]
    schema = "contract_id string, month int, " + ", ".join(f"{c} bigint" for c in columns) + ", label double, weight double"
    prep = spark.createDataFrame(rows, schema)
    got = models.sequence_input(prep, columns, STAR, "contract_id", models.total(STAR.count_features)).orderBy("month").collect()
    assert columns[-1] == last
    assert [r["steps_since_use"] for r in got] == [0, 1, 0, 1, 2]


def test_trees_scan_one_vector(spark):
    """The staged input of boosted trees has its vector, so no scan puts it together again."""
    rows = [("c", m, *[0] * 14, 0.0, 1.0) for m in range(3)]
    columns = [*STAR.time_features, *STAR.count_features]
    schema = "contract_id string, month int, " + ", ".join(f"{c} bigint" for c in columns) + ", label double, weight double"
    got = models.sequence_input(spark.createDataFrame(rows, schema), columns, STAR, "contract_id", models.total(STAR.count_features))
    names = models.history_names(columns)
    row = got.orderBy("month").collect()[-1]
    assert list(row["features"]) == [row[n] for n in names]
    assert models.assemble(got, names).columns == got.columns


def test_null_keys_are_spread(spark):
    facts = spark.range(2000).select(F.lit(None).cast("int").alias("k"), F.col("id").alias("v"))
    facts = facts.unionByName(spark.createDataFrame([(1, -1), (2, -2)], "k int, v bigint"))
    dims = spark.createDataFrame([(1, "one"), (None, "none")], "k int, name string")
    joined = skew.skew_join(facts, dims, ["k"], ["v"], "left", floor=10)
    fixed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in fixed.items():
        spark.conf.set(key, value)
    try:
        parts = joined.select(F.spark_partition_id().alias("p"), "name").groupBy("p").count().collect()
    finally:
        for key in fixed:
            spark.conf.unset(key)
    rows = joined.collect()
    assert len(rows) == 2002 and [r["name"] for r in rows if r["name"]] == ["one"]
    assert max(r["count"] for r in parts) < 1500


def test_filled_samples(spark):
    cfg = replace(EVENTS, horizon_days=6, interest=("a",), categories=("a",))
    schema = "seat_id string, x array<struct<day:int,f:array<bigint>>>, seat_create int, seat_cancel int"
    rows = [("s", [(4, [7, 1])], -1, 2), ("t", None, 4, None), ("u", None, 3, 1)]
    got = {r["seat_id"]: [(c["day"], list(c["f"])) for c in r["x"]] for r in samples.fill_life(spark.createDataFrame(rows, schema), cfg).collect()}
    assert got == {"s": [(0, [0, 0]), (1, [0, 0]), (2, [0, 0]), (4, [7, 1])], "t": [(4, [0, 0]), (5, [0, 0])], "u": []}


def test_losses_are_points_too(spark):
    history = spark.createDataFrame([("m", 0, 0.7, 0.8), ("m", 1, 0.5, 0.9)], "model string, iteration int, train_loss double, valid_loss double")
    scored = spark.createDataFrame([(1, 0.9), (0, 0.1)], "label int, score double")
    got = evaluate.curve_tables(evaluate.confusion_curve(scored), history=history).collect()
    losses = sorted((r["curve"], r["x"], r["y"]) for r in got if r["curve"].endswith("loss"))
    assert losses == [("train_loss", 0.0, 0.7), ("train_loss", 1.0, 0.5), ("valid_loss", 0.0, 0.8), ("valid_loss", 1.0, 0.9)]
    assert {r["curve"] for r in got} == {"roc", "pr", "train_loss", "valid_loss"}


def test_stages_are_removed_at_the_end_of_a_run(spark):
    child = spark.newSession()
    with workspace.run(child):
        kept = workspace.stage(child.range(5), "n").inputFiles()
        assert kept and workspace.own_root(child) in kept[0]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        child.read.parquet(workspace.own_root(child)).count()


def test_models_learn_a_label_that_follows_usage(spark):
    rows = spark.range(1500).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("contract_id"), F.lit(0).alias("month"),
        (F.pmod(F.xxhash64("id"), 100) / 100).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), 100) / 100).alias("y"), F.lit(1.0).alias("weight"),
    )
    rows = workspace.stage(models.with_split(rows.withColumn("label", (F.col("x") < 0.3).cast("double"))), "learnable")
    for fit in (models.fit_logreg, models.fit_mlp, models.fit_gbt):
        area = models.areas(models.test_curve(fit(rows, ["x", "y"]), rows, ["x", "y"])).first()["auc_roc"]
        assert area > 0.9, fit.__name__
