"""Models on the smallest tables: shapes, determinism and the out-of-fold rule."""

import pytest
from pyspark.sql import Observation, functions as F

from registry import QUERIES
from registry.core import dates
from registry.models import TABULAR
from seatwise.fixtures import STAR
from seatwise.plans import models
from seatwise.plans.prep import prep_seat_monthly, prep_tabular_baseline
from seatwise.workspace import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def used(spark):
    return dates(spark, SF)


@pytest.fixture(scope="module")
def tabular(used):
    return models.scaled_split(prep_tabular_baseline(used, STAR), TABULAR, STAR)


def test_input_is_complete(tabular):
    assert tabular.filter("label = -1").count() == 0
    assert tabular.filter(" or ".join(f"{f} is null" for f in TABULAR)).count() == 0
    assert {r.split for r in tabular.select("split").distinct().collect()} == {"train", "valid", "test"}
    assert tabular.groupBy("contract_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0


def test_logreg_is_repeatable_and_scores_every_row(tabular):
    first, second = (models.fit_logreg(tabular, TABULAR, 0.01) for _ in range(2))
    assert first.coefficients == second.coefficients
    scored = models.scores(first, models.assemble(tabular, TABULAR))
    assert scored.count() == tabular.count() and scored.filter("score between 0 and 1").count() == tabular.count()


def test_history_features(spark):
    df = spark.createDataFrame([("k", m, v) for m, v in [(2, 1.0), (3, 0.0), (4, 4.0)]] + [("j", 0, 0.0)], "id string, month int, x double")
    rows = {(r.id, r.month): r for r in models.history_features(df, "id", ["x"], "x").collect()}
    last = rows["k", 4]
    assert (last.lag1_x, last.lag2_x, last.max_so_far_x, last.delta_x, last.steps_alive, last.steps_since_use) == (0, 1, 4, 4, 2, 0)
    assert last.mean_so_far_x == pytest.approx(5 / 3)
    assert (rows["k", 3].steps_since_use, rows["k", 2].delta_x, rows["j", 0].steps_since_use) == (1, 0, 0)
    assert set(models.history_names(["x"])) <= set(models.history_features(df, "id", ["x"], "x").columns)


def test_seat_stage_scores(used):
    seat_rows = stage(prep_seat_monthly(used, STAR), "seat_rows")
    scored = models.seat_stage_scores(seat_rows, STAR).cache()
    assert scored.count() == seat_rows.count() == scored.select("seat_id", "month").distinct().count()
    assert scored.filter((F.col("label") == -1) != F.col("latent_score").isNull()).count() == 0
    pooled, names = models.hierarchical_input(scored, used, STAR)
    assert pooled.filter(" or ".join(f"{n} is null" for n in names)).count() == 0


@pytest.mark.parametrize("name", ["logreg_monthly", "mlp_monthly", "sequence_monthly", "sequence_daily"])
def test_areas(spark, name):
    """The area under the curve is the rank statistic of the same scores, and all is in range."""
    row = QUERIES[name](spark, SF).first()
    assert row.area_agrees and row.scores_in_range and row.pr_in_range
    assert row.n_kept > 0


def test_history_and_choice(spark, tabular):
    fitted = models.fit_logreg(tabular, TABULAR)
    loss = models.training_history(spark, "logreg", fitted.summary.objectiveHistory).orderBy("iteration").collect()
    assert loss[0].iteration == 0 and loss[-1].objective <= loss[0].objective
    candidates = {f"reg={reg}": models.fit_logreg(tabular, TABULAR, reg) for reg in (0.0, 0.1)}
    best = models.select_best(candidates, tabular, TABULAR).collect()
    assert sum(r.is_best for r in best) == 1 and all(r.auc_roc is None or 0 <= r.auc_roc <= 1 for r in best)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scores_after_observe(spark):
    """An observation stays with the session; a fitted model's summary must not carry both to the tasks."""
    watch = Observation()
    spark.range(3).observe(watch, F.count(F.lit(1)).alias("n")).collect()
    assert watch.get["n"] == 3
    rows = spark.createDataFrame([(float(i), i % 3 % 2, 1.0, "train") for i in range(30)], "x double, label int, weight double, split string")
    fitted = models.fit_logreg(rows, ["x"])
    found = models.scores(fitted, models.assemble(rows, ["x"])).filter("score between 0 and 1")
    assert found.count() == 30 and fitted.hasSummary
