"""Exact ROC and precision-recall curves and their areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seatwise.operators.running import running_totals, value_buckets

# Distinct scores are sorted in this many parts.
N_BUCKETS = 200


def filter_scored(df: DataFrame, label: str = "label") -> DataFrame:
    """Cells that count in an evaluation: those inside life."""
    return df.filter(F.col(label) != -1)


def confusion_curve(
    scored: DataFrame, score: str = "score", label: str = "label", n_buckets: int = N_BUCKETS
) -> DataFrame:
    """Per distinct score, as threshold: its own positives and negatives, the running true and false
    positives, and the totals.

    Equal scores are merged before the shuffle; the running counts are summed bucket by bucket.
    """
    per_score = scored.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    # Naming both counts, here and in the totals, keeps all branches on one shuffle of per_score.
    bucketed = value_buckets(per_score, "threshold", n_buckets, F.col("pos") + F.col("neg") > 0)
    curve = running_totals(
        bucketed, F.desc("threshold"), {"tp": "pos", "fp": "neg"}, ascending=False
    ).drop("_bucket")
    totals = per_score.agg(F.struct(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))).scalar()
    return curve.withColumns({name: totals[name] for name in ("n_pos", "n_neg")})


def roc_curve(curve: DataFrame) -> DataFrame:
    """``(threshold, fpr, tpr)`` at each distinct score."""
    return curve.select(
        "threshold",
        F.try_divide(F.col("fp"), F.col("n_neg")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )


def _roc_area() -> Column:
    # The point before a score has its true positives without the score's own; doubled to stay integral.
    twice_area = F.sum((F.col("neg") * (F.col("tp") * 2 - F.col("pos"))).cast("decimal(38,0)")).cast("double")
    cells = F.max("n_pos").cast("double") * F.max("n_neg").cast("double")
    return F.try_divide(twice_area, cells * 2).alias("auc_roc")


def auc_roc(curve: DataFrame) -> DataFrame:
    """Trapezoid area under the ROC curve from (0, 0)."""
    return curve.agg(_roc_area())


def pr_curve(curve: DataFrame) -> DataFrame:
    """``(threshold, recall, precision)`` at each distinct score, and the end point (0, 1)."""
    points = curve.select(
        "threshold",
        F.try_divide(F.col("tp"), F.col("n_pos")).alias("recall"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )
    totals = curve.agg(F.max("n_pos").alias("n_pos"))
    end = totals.select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")
    )
    return points.unionByName(end)


def _pr_area() -> Column:
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    before = tp + fp - pos - neg
    precision_before = F.when(before == 0, F.lit(1.0)).otherwise(F.try_divide(tp - pos, before))
    step = F.try_divide(pos, F.col("n_pos")) * (precision_before + F.try_divide(tp, tp + fp)) / 2
    return F.sum(step).alias("auc_pr")


def auc_pr(curve: DataFrame) -> DataFrame:
    """Trapezoid area under the precision-recall curve from (0, 1).

    Not Spark's ``areaUnderPR``, whose curve starts at (0, first precision).
    """
    return curve.agg(_pr_area())


def areas(curve: DataFrame) -> DataFrame:
    """``(auc_roc, auc_pr)`` in one pass over the curve."""
    return curve.agg(_roc_area(), _pr_area())


def loss_points(history: DataFrame) -> DataFrame:
    """Losses by iteration as points to plot: ``(curve, x, y)``, a curve for each loss column of ``history``."""
    losses = [c for c in history.columns if c not in ("model", "iteration")]
    points = history.unpivot(["iteration"], losses, "curve", "y")
    return points.select("curve", F.col("iteration").cast("double").alias("x"), "y")


def curve_tables(curve: DataFrame, n_steps: int | None = None, history: DataFrame | None = None) -> DataFrame:
    """ROC and precision-recall points in one long table to plot: ``(curve, x, y)``; with the losses of a training
    ``history``, if one is given.

    ``n_steps`` thins the areas' curves: of the points with the same ``x`` up to ``1 / n_steps``, the highest.
    """
    if history is not None:
        return curve_tables(curve, n_steps).unionByName(loss_points(history))
    roc = roc_curve(curve).select(F.lit("roc").alias("curve"), F.col("fpr").alias("x"), F.col("tpr").alias("y"))
    pr = pr_curve(curve).select(F.lit("pr").alias("curve"), F.col("recall").alias("x"), F.col("precision").alias("y"))
    points = roc.unionByName(pr)
    if n_steps is None:
        return points
    x = F.floor(F.col("x") * n_steps) / n_steps
    return points.groupBy("curve", x.alias("x")).agg(F.max("y").alias("y"))


def model_comparison(results: dict[str, DataFrame]) -> DataFrame:
    """``(model, auc_roc, auc_pr)`` from one confusion curve per model."""
    rows = None
    for model, curve in results.items():
        row = areas(curve).select(F.lit(model).alias("model"), "auc_roc", "auc_pr")
        rows = row if rows is None else rows.unionByName(row)
    return rows
