"""Curves and areas of a score that has ties, and of one on the churn months."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import dates, query, star
from seatwise.fixtures import STAR, table
from seatwise.operators import evaluate
from seatwise.plans.prep import prep_sequence_baseline

_SCORED_SQL = "select quality as label, (doc_id * 37 % 101) / cast(101 as double) as score from labels"


def curve_sql(scored: str) -> str:
    return f"""with scored as ({scored}),
per_score as (select score as threshold, count(case when label = 1 then 1 end) as pos, count(case when label = 0 then 1 end) as neg
              from scored group by score),
curve as (select threshold, pos, neg, cast(sum(pos) over w as bigint) as tp, cast(sum(neg) over w as bigint) as fp,
                 cast(sum(pos) over () as bigint) as n_pos, cast(sum(neg) over () as bigint) as n_neg
          from per_score window w as (order by threshold desc))
"""


_ROC = "select round(threshold, 9) as threshold, round(fp / cast(n_neg as double), 9) as fpr, round(tp / cast(n_pos as double), 9) as tpr from curve"
_PR = """select round(threshold, 9) as threshold, round(tp / cast(n_pos as double), 9) as recall, round(tp / cast(tp + fp as double), 9) as precision
from curve union all select -1.0, 0.0, 1.0"""
AUC_ROC_SQL = """select round(sum((fpr - coalesce(f0, 0)) * (tpr + coalesce(t0, 0)) / 2), 9) as auc_roc
from (select fpr, tpr, lag(fpr) over (order by threshold desc) as f0, lag(tpr) over (order by threshold desc) as t0
      from (select threshold, fp / cast(n_neg as double) as fpr, tp / cast(n_pos as double) as tpr from curve))"""
AUC_PR_SQL = """select round(sum((rec - coalesce(r0, 0)) * (pre + coalesce(p0, 1)) / 2), 9) as auc_pr
from (select rec, pre, lag(rec) over (order by threshold desc) as r0, lag(pre) over (order by threshold desc) as p0
      from (select threshold, tp / cast(n_pos as double) as rec, tp / cast(tp + fp as double) as pre from curve))"""


def _curve(spark, sf):
    score = (F.col("doc_id") * 37 % 101) / F.lit(101.0)
    return evaluate.confusion_curve(table(spark, sf, "labels").select(F.col("quality").alias("label"), score.alias("score")))


def _round9(df, columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("confusion_curve", curve_sql(_SCORED_SQL) + "select round(threshold, 9) as threshold, pos, neg, tp, fp, n_pos, n_neg from curve")
def _(spark, sf):
    return _round9(_curve(spark, sf), ["threshold"])


@query("roc_curve", curve_sql(_SCORED_SQL) + _ROC)
def _(spark, sf):
    return _round9(evaluate.roc_curve(_curve(spark, sf)), ["threshold", "fpr", "tpr"])


@query("auc_roc", curve_sql(_SCORED_SQL) + AUC_ROC_SQL)
def _(spark, sf):
    return _round9(evaluate.auc_roc(_curve(spark, sf)), ["auc_roc"])


@query("pr_curve", curve_sql(_SCORED_SQL) + _PR)
def _(spark, sf):
    df = evaluate.pr_curve(_curve(spark, sf)).fillna(-1.0, ["threshold"])
    return _round9(df, ["threshold", "recall", "precision"])


@query("auc_pr", curve_sql(_SCORED_SQL) + AUC_PR_SQL)
def _(spark, sf):
    return _round9(evaluate.auc_pr(_curve(spark, sf)), ["auc_pr"])


@query(
    "curve_tables",
    curve_sql(_SCORED_SQL)
    + """select 'roc' as curve, round(fp / cast(n_neg as double), 9) as x, round(tp / cast(n_pos as double), 9) as y from curve
union all select 'pr', round(tp / cast(n_pos as double), 9), round(tp / cast(tp + fp as double), 9) from curve
union all select 'pr', 0.0, 1.0""",
)
def _(spark, sf):
    return _round9(evaluate.curve_tables(_curve(spark, sf)), ["x", "y"])


_MONTHS_SQL = """select p.contract_id, p.month, l.label, (p.total * 31 % 97) / cast(97 as double) as score
from (select contract_id, month, cast(coalesce(sum(case when label <> -1 then {time} end), 0) as bigint) as total
      from seat_month group by contract_id, month) p
join contract_label l on l.contract_id = p.contract_id and l.month = p.month where l.label <> -1""".format(
    time=" + ".join(STAR.time_features)
)


def _scored_months(spark, sf):
    from seatwise.functions.vectors import total

    df = evaluate.filter_scored(prep_sequence_baseline(dates(spark, sf), STAR))
    score = (total(STAR.time_features) * 31 % 97) / F.lit(97.0)
    return df.select("contract_id", "month", "label", score.alias("score"))


@query("filter_scored", star(_MONTHS_SQL.replace("(p.total * 31 % 97) / cast(97 as double) as score", "p.total * 31 % 97 as score")))
def _(spark, sf):
    df = _scored_months(spark, sf)
    return df.withColumn("score", F.round(F.col("score") * 97).cast("bigint"))


@query("auc_churn_months", star(curve_sql(_MONTHS_SQL) + f"select * from ({AUC_ROC_SQL}) cross join ({AUC_PR_SQL})"))
def _(spark, sf):
    return _round9(evaluate.areas(evaluate.confusion_curve(_scored_months(spark, sf))), ["auc_roc", "auc_pr"])
