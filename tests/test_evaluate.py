"""Curves, areas, running totals and splits against plain loops."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from seatwise.operators import evaluate, split
from seatwise.operators.running import running_totals, value_buckets


def points(scored):
    """(threshold, true positives, false positives) by falling score."""
    result = []
    for threshold in sorted({s for s, _ in scored}, reverse=True):
        chosen = [label for s, label in scored if s >= threshold]
        result.append((threshold, chosen.count(1), chosen.count(0)))
    return result


def truth(scored):
    n_pos, n_neg = (sum(1 for _, v in scored if v == k) for k in (1, 0))
    roc, pr = [(0.0, 0.0)], [(0.0, 1.0)]
    for _, tp, fp in points(scored):
        roc.append((fp / n_neg, tp / n_pos))
        pr.append((tp / n_pos, tp / (tp + fp)))
    area = lambda line: sum((x - x0) * (y + y0) / 2 for (x0, y0), (x, y) in zip(line, line[1:]))
    return area(roc), area(pr)


CASES = {
    "many scores": [(random.Random(i).random(), random.Random(-i).randrange(3) == 0) for i in range(1, 900)],
    "ties": [(i % 7 / 7, i * i % 5 in (1, 2)) for i in range(300)],
    "one score": [(0.5, i % 3 == 0) for i in range(30)],
    "half in one score": [(0.0 if i % 2 else i / 1000, i % 5 == 0) for i in range(600)],
    "perfect": [(i / 10, i > 6) for i in range(10)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("n_buckets", [2, 50])
def test_curves_and_areas(spark, name, n_buckets):
    scored = [(float(s), int(v)) for s, v in CASES[name]]
    df = spark.createDataFrame(scored, "score double, label int").repartition(5)
    curve = evaluate.confusion_curve(df, n_buckets=n_buckets)
    rows = sorted(((r.threshold, r.tp, r.fp) for r in curve.collect()), reverse=True)
    assert rows == points(scored)
    roc, pr = truth(scored)
    both = evaluate.areas(curve).first()
    assert both.auc_roc == pytest.approx(roc, abs=1e-12) == evaluate.auc_roc(curve).first()[0]
    assert both.auc_pr == pytest.approx(pr, abs=1e-12) and evaluate.auc_pr(curve).first()[0] == pytest.approx(pr)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert evaluator.evaluate(df) == pytest.approx(roc)
    assert evaluate.roc_curve(curve).count() + 1 == evaluate.pr_curve(curve).count() == len(rows) + 1


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert evaluate.areas(evaluate.confusion_curve(df)).first().auc_roc is None


def test_curve_tables_thinned(spark):
    scored = [(float(s), int(v)) for s, v in CASES["many scores"]]
    curve = evaluate.confusion_curve(spark.createDataFrame(scored, "score double, label int"))
    whole, thin = evaluate.curve_tables(curve), evaluate.curve_tables(curve, 20)
    assert thin.count() <= 42 < whole.count()


def test_filter_scored(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,)], "label int")
    assert sorted(r.label for r in evaluate.filter_scored(df).collect()) == [0, 1]


def test_model_comparison(spark):
    curves = {}
    for name in ("ties", "perfect"):
        scored = [(float(s), int(v)) for s, v in CASES[name]]
        curves[name] = evaluate.confusion_curve(spark.createDataFrame(scored, "score double, label int"))
    rows = {r.model: r for r in evaluate.model_comparison(curves).collect()}
    assert rows["perfect"].auc_roc == 1.0 and rows["perfect"].auc_pr == 1.0 and 0 < rows["ties"].auc_roc < 1


@pytest.mark.parametrize("ascending", [True, False])
def test_running_totals(spark, ascending):
    df = spark.range(1000).selectExpr("id as x", "id % 13 as v").repartition(7)
    order = F.asc("x") if ascending else F.desc("x")
    rows = running_totals(value_buckets(df, "x", 10), order, {"t": "v"}, ascending).collect()
    for r in rows:
        assert r.t == sum(i % 13 for i in (range(r.x + 1) if ascending else range(r.x, 1000)))
    assert len({r._bucket for r in rows}) == 10


def contracts(spark, n):
    return spark.range(n * 3).selectExpr(f"concat('c', id % {n}) as contract_id", "id as seat")


def test_exact_split(spark):
    rows = contracts(spark, 500)
    sizes = {"train": 200, "valid": 50, "test": 30}
    first = {r.contract_id: r.split for r in split.group_split_exact(rows, sizes, "a").collect()}
    again = {r.contract_id: r.split for r in split.group_split_exact(rows.repartition(11), sizes, "a").collect()}
    other = {r.contract_id: r.split for r in split.group_split_exact(rows, sizes, "b").collect()}
    assert first == again != other
    assert {s: list(first.values()).count(s) for s in sizes} == sizes


@pytest.mark.parametrize("most", [0, 280])
def test_apply_and_semi_join(spark, monkeypatch, most):
    monkeypatch.setattr(split, "MAX_BROADCAST_CONTRACTS", most)
    rows = contracts(spark, 500)
    member = split.group_split_exact(rows, {"train": 200, "valid": 50, "test": 30}, "a")
    applied = split.apply_split(rows, member)
    assert applied.count() == 280 * 3
    assert applied.groupBy("contract_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    train = split.semi_join_split(rows, member.filter("split = 'train'"))
    assert train.count() == 600 and set(train.columns) == set(rows.columns)


def test_fraction_split(spark):
    rows = contracts(spark, 4000)
    got = split.group_split_fraction(rows, {"train": 0.5, "valid": 0.25, "test": 0.25}, "x")
    n = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert sum(n.values()) == 4000 and None not in n and abs(n["train"] - 2000) < 150
    part = split.group_split_fraction(rows, {"train": 0.1}, "x").filter("split is not null").count()
    assert abs(part - 400) < 100
