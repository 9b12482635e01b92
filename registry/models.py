"""Models. Fitted numbers have no SQL equivalent, so queries return what SQL knows of them: keys, labels, counts, and
whether scores, areas, losses and optimality are as they must be."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from registry.core import CATEGORIES, FEATURES, dates, label_sql, query, star
from registry.splits import SPLIT_SQL
from seatwise.fixtures import STAR
from seatwise.functions.vectors import total
from seatwise.operators.evaluate import N_BUCKETS, areas, model_comparison
from seatwise.operators.running import running_totals, value_buckets
from seatwise.plans import models, recurrent
from seatwise.plans.prep import prep_seat_monthly, prep_sequence_baseline, prep_tabular_baseline
from seatwise.training.epochs import Schedule
from seatwise.training.newton import fit_newton
from seatwise.training.perceptron import fit_perceptron
from seatwise.training.recurrent import RecurrentConfig, fit_recurrent

TABULAR = STAR.features + STAR.lifetime_features + ["n_seats"]
SEQUENCE = STAR.features + ["n_seats"]


def _tabular(used):
    return models.scaled_split(prep_tabular_baseline(used, STAR), TABULAR, STAR)


def _sequence(used):
    rows = models.sequence_input(prep_sequence_baseline(used, STAR), SEQUENCE, STAR, "contract_id", total(STAR.count_features))
    return rows, models.history_names(SEQUENCE)


def rank_area(scored: DataFrame) -> DataFrame:
    """Rows by label and the share of (churned, kept) pairs in the right order, ties counting half: another way to the ROC
    area. Equal scores are merged first, then what lies below each score is summed bucket by bucket."""
    per_score = scored.groupBy(F.col("score").cast("double").alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), F.count_if(~F.col("score").between(0, 1)).alias("outside")
    )
    bucketed = value_buckets(per_score, "score", N_BUCKETS, F.col("pos") + F.col("neg") > 0)
    ranked = running_totals(bucketed, F.asc("score"), {"below": "neg"}, ascending=True)
    churned, kept, outside = (F.coalesce(F.sum(c), F.lit(0)) for c in ("pos", "neg", "outside"))
    twice = F.sum((F.col("pos") * (F.col("below") * 2 - F.col("neg"))).cast("decimal(38,0)")).cast("double")
    return ranked.agg(
        churned.alias("n_churned"), kept.alias("n_kept"), F.try_divide(twice, churned.cast("double") * kept * 2).alias("rank_area"), outside.alias("n_outside")
    )


def _evaluated(model, rows, features):
    """Test rows by label, and whether both areas and all scores are as they must be."""
    return _checked(models.scores(model, models.assemble(models.part(rows, "test"), features)).select("label", "score"))


def _checked(test_scores):
    scored = models.stage(test_scores, "scored")
    found = areas(models.confusion_curve(scored))
    same = (F.abs(F.coalesce("auc_roc", F.lit(-1.0)) - F.coalesce("rank_area", F.lit(-1.0))) < 1e-9)
    return rank_area(scored).withColumns({c: found.select(c).scalar() for c in ("auc_roc", "auc_pr")}).select(
        "n_churned", "n_kept", (F.col("n_outside") == 0).alias("scores_in_range"), same.alias("area_agrees"),
        F.coalesce(F.col("auc_pr").between(0, 1), F.col("n_churned") == 0).alias("pr_in_range"),
    )


_EVALUATED_SQL = star(f"""select count(case when l.label = 1 then 1 end) as n_churned, count(case when l.label = 0 then 1 end) as n_kept,
  true as scores_in_range, true as area_agrees, true as pr_in_range
from contract_label l join ({SPLIT_SQL}) s on s.contract_id = l.contract_id where s.split = 'test' and l.label <> -1""")


@query("logreg_monthly", _EVALUATED_SQL)
def _(spark, sf):
    rows = _tabular(dates(spark, sf))
    return _evaluated(models.fit_logreg(rows, TABULAR), rows, TABULAR)


PENALTY = 1e-4


@query("logreg_optimality", " union all ".join(f"select '{f}' as feature, 0.0::double as residual" for f in TABULAR))
def _(spark, sf):
    """At the optimum the weighted mean of (probability - label) times a feature, plus the penalty's slope, is 0 for every
    feature; residuals below 1e-6 count as 0."""
    rows = _tabular(dates(spark, sf))
    model = fit_newton(rows, TABULAR, PENALTY)
    train = model.scored(models.part(rows, "train"))
    miss = F.col("weight") * (F.col("score") - F.col("label"))
    slopes = [F.sum(miss * F.col(f)) / F.sum("weight") + PENALTY * float(c) for f, c in zip(TABULAR, model.coefficients)]
    means = train.agg(*[F.when(F.abs(slope) < 1e-6, 0.0).otherwise(slope).alias(f) for f, slope in zip(TABULAR, slopes)])
    residual = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("residual")) for f in TABULAR]))
    return means.select(residual.alias("r")).select("r.feature", "r.residual")


@query("logreg_history", "select 'logreg' as model, true as consecutive, true as train_loss_falls, true as valid_loss_known, true as converged")
def _(spark, sf):
    """Train and valid loss of each Newton step."""
    rows = _tabular(dates(spark, sf))
    model = fit_newton(rows, TABULAR, PENALTY)
    history = spark.createDataFrame([("logreg", *h) for h in model.history], "model string, iteration int, train_loss double, valid_loss double")
    known = F.lit(all(valid == valid for *_, valid in model.history))
    return _history_checks(history, ["train_loss"]).select("*", known.alias("valid_loss_known"), F.lit(model.converged).alias("converged"))


@query("mlp_monthly", _EVALUATED_SQL)
def _(spark, sf):
    rows = _tabular(dates(spark, sf))
    return _evaluated(models.fit_mlp(rows, TABULAR), rows, TABULAR)


PERCEPTRON = Schedule(epochs=12, rate=0.05, patience=4)
MONTH_KEY = ["contract_id", "month"]


@query("perceptron_monthly", _EVALUATED_SQL)
def _(spark, sf):
    """The perceptron with batch normalisation, dropout and weights as they are, best epoch of the valid split."""
    rows = _tabular(dates(spark, sf))
    model = fit_perceptron(rows, TABULAR, MONTH_KEY, schedule=PERCEPTRON)
    return _checked(model.scored(models.part(rows, "test").select("label", *TABULAR)).select("label", "score"))


LAGGED = [FEATURES[0], FEATURES[-1]]
_LAGS = ", ".join(f"coalesce(lag({f}, {k}) over w, 0) as lag{k}_{f}" for f in LAGGED for k in (1, 2))


@query(
    "sequence_features",
    star(f"""select contract_id, month, coalesce(lag(used, 1) over w, 0) as lag1, coalesce(lag(used, 2) over w, 0) as lag2, {_LAGS},
  round(avg(used) over w, 6) as mean_so_far, max(used) over w as max_so_far, used - coalesce(lag(used, 1) over w, used) as delta,
  month - min(month) over w as months_alive,
  month - coalesce(max(case when used > 0 then month end) over w, min(month) over w) as months_since_use
from (select p.* from
  (select contract_id, month, cast(coalesce(sum(case when label <> -1 then {" + ".join(f"count_{c}" for c in CATEGORIES)} end), 0) as double) as used,
     {", ".join(f"cast(coalesce(sum(case when label <> -1 then {f} end), 0) as double) as {f}" for f in LAGGED)}
   from seat_month group by contract_id, month) p
  join contract_label l on l.contract_id = p.contract_id and l.month = p.month where l.label <> -1)
window w as (partition by contract_id order by month)"""),
)
def _(spark, sf):
    months = models.filter_scored(prep_sequence_baseline(dates(spark, sf), STAR))
    features = ["used", *LAGGED]
    rows = months.select("contract_id", "month", total(STAR.count_features).cast("double").alias("used"), *[F.col(f).cast("double").alias(f) for f in LAGGED])
    df = models.history_features(rows, "contract_id", features, "used")
    return df.select(
        "contract_id", "month", F.col("lag1_used").alias("lag1"), F.col("lag2_used").alias("lag2"),
        *[f"lag{k}_{f}" for f in LAGGED for k in (1, 2)],
        F.round("mean_so_far_used", 6).alias("mean_so_far"), F.col("max_so_far_used").alias("max_so_far"),
        F.col("delta_used").alias("delta"),
        F.col("steps_alive").alias("months_alive"),
        F.col("steps_since_use").alias("months_since_use"),
    )


@query("sequence_monthly", _EVALUATED_SQL)
def _(spark, sf):
    rows, names = _sequence(dates(spark, sf))
    return _evaluated(models.fit_gbt(rows, names), rows, names)


_DAY_LABEL = label_sql("p.period", "cast(floor(c.create_day / 30.0) as int)", "cast(floor(c.cancel_day / 30.0) as int)", 13)


@query(
    "sequence_daily",
    star(f"""select count(case when label = 1 then 1 end) as n_churned, count(case when label = 0 then 1 end) as n_kept,
  true as scores_in_range, true as area_agrees, true as pr_in_range
from (select c.contract_id, {_DAY_LABEL} as label from contracts c cross join (select cast(unnest(range(13)) as int) as period) p) l
join ({SPLIT_SQL}) s on s.contract_id = l.contract_id where s.split = 'test' and l.label <> -1"""),
)
def _(spark, sf):
    rows, names = models.daily_group_input(dates(spark, sf), STAR)
    return _evaluated(models.fit_gbt(rows, names), rows, names)


_SEAT_STATE = ", ".join(f"stddev_pop(case when split = 'train' and label <> -1 then {f} end) as std_{f}" for f in FEATURES)


def _squeezed(features) -> str:
    return " + ".join(f"coalesce(m.{f} / nullif(t.std_{f}, 0), -1)" for f in features)


_SEAT_SQL = f"""with parts as (select m.*, s.split from seat_month m join ({SPLIT_SQL}) s on s.contract_id = m.contract_id),
state as (select month, {_SEAT_STATE} from parts group by month)"""


@query(
    "seat_stage_scores",
    star(f"""{_SEAT_SQL}
select m.seat_id, m.contract_id, m.month, m.split, m.label, true as scored_if_live,
  case when m.label <> -1 then round({_squeezed(STAR.time_features)}, 6) else -999 end as squeezed_time,
  case when m.label <> -1 then round({_squeezed(STAR.count_features)}, 6) else -999 end as squeezed_count
from parts m join state t on t.month = m.month"""),
)
def _(spark, sf):
    scored = models.seat_stage_scores(prep_seat_monthly(dates(spark, sf), STAR), STAR)
    live = F.col("label") != -1
    right = F.when(live, F.coalesce(F.col("latent_score").between(0, 1) & F.col("latent_margin").isNotNull(), F.lit(False))).otherwise(F.col("latent_score").isNull())
    return scored.select(
        "seat_id", "contract_id", "month", "split", "label", right.alias("scored_if_live"),
        *[F.round(F.coalesce(c, F.lit(-999.0)), 6).alias(c) for c in ("squeezed_time", "squeezed_count")],
    )


@query(
    "seat_stage_areas",
    star(f"""select s.split, count(case when m.label = 1 then 1 end) as n_churned, count(case when m.label = 0 then 1 end) as n_kept,
  true as area_agrees
from seat_month m join ({SPLIT_SQL}) s on s.contract_id = m.contract_id where m.label <> -1 group by s.split"""),
)
def _(spark, sf):
    """Stage 1 on its own: areas of the seat-level score by split."""
    scored = models.stage(models.seat_stage_scores(prep_seat_monthly(dates(spark, sf), STAR), STAR), "seat_scores")
    result = None
    for split in models.SHARES:
        rows = models.part(scored, split).filter("label <> -1").select("label", F.col("latent_score").alias("score"))
        area = areas(models.confusion_curve(rows)).select("auc_roc").scalar()
        row = rank_area(rows).select(
            F.lit(split).alias("split"), "n_churned", "n_kept",
            (F.abs(F.coalesce(area, F.lit(-1.0)) - F.coalesce("rank_area", F.lit(-1.0))) < 1e-9).alias("area_agrees"),
        )
        result = row if result is None else result.unionByName(row)
    return result


def _hierarchical(used):
    seat_scores = models.stage(models.seat_stage_scores(prep_seat_monthly(used, STAR), STAR), "seat_scores")
    return models.hierarchical_input(seat_scores, used, STAR)


DAYS = Schedule(epochs=6, rate=0.08, patience=3)


@query(
    "recurrent_seat_daily",
    star(f"""select count(case when label = 1 then 1 end) as n_churned, count(case when label = 0 then 1 end) as n_kept,
  true as scores_in_range, true as area_agrees, true as pr_in_range
from (select s.contract_id, {label_sql('d.day', 's.create_day', 's.cancel_day', 365)} as label from seats s cross join (select cast(unnest(range(365)) as int) as day) d) l
join ({SPLIT_SQL}) s on s.contract_id = l.contract_id where s.split = 'test' and l.label <> -1"""),
)
def _(spark, sf):
    """The recurrent model over the days of a seat's life, with gradients of spans of 30 days."""
    table = recurrent.seat_day_sequences(dates(spark, sf), STAR)
    return _checked(recurrent.split_scores(fit_recurrent(table, len(STAR.features), recurrent.DAILY, DAYS), table))


MONTHS = Schedule(epochs=20, rate=0.05, patience=6)
SEATS = Schedule(epochs=8, rate=0.08, patience=3)


def _month_sequences(used):
    return recurrent.month_sequences(prep_sequence_baseline(used, STAR), SEQUENCE, STAR)


@query("recurrent_monthly", _EVALUATED_SQL)
def _(spark, sf):
    """The recurrent model over contract months, best epoch of the valid split."""
    table = _month_sequences(dates(spark, sf))
    return _checked(recurrent.split_scores(fit_recurrent(table, len(SEQUENCE), schedule=MONTHS), table))


def _epoch_checks(spark, fitted, model, schedule):
    first = F.min_by("train_loss", "iteration")
    best = F.max(F.when(F.col("iteration") == fitted.best_epoch, F.col("valid_loss")))
    return fitted.table(spark, model).groupBy("model").agg(
        (F.count_distinct("iteration") == F.max("iteration") + 1).alias("consecutive"), (F.min("train_loss") < first).alias("learns"),
        (best == F.min("valid_loss")).alias("best_is_least"), (F.max("iteration") - fitted.best_epoch <= schedule.patience).alias("patient"),
    )


_EPOCHS_SQL = "select '{}' as model, true as consecutive, true as learns, true as best_is_least, true as patient"


@query("recurrent_history", _EPOCHS_SQL.format("recurrent"))
def _(spark, sf):
    """Losses of both splits by epoch; the epoch that is restored has the least valid loss, and no run outlasts its patience."""
    table = _month_sequences(dates(spark, sf))
    return _epoch_checks(spark, fit_recurrent(table, len(SEQUENCE), schedule=MONTHS).fitted, "recurrent", MONTHS)


@query("perceptron_history", _EPOCHS_SQL.format("perceptron"))
def _(spark, sf):
    """Losses of both splits by epoch of the perceptron, and its patience."""
    fitted = fit_perceptron(_tabular(dates(spark, sf)), TABULAR, MONTH_KEY, schedule=PERCEPTRON).fitted
    return _epoch_checks(spark, fitted, "perceptron", PERCEPTRON)


UNITS = RecurrentConfig().units


@query(
    "seat_latent_states",
    star(f"""{_SEAT_SQL}
select m.seat_id, m.contract_id, m.month, m.split, m.label, case when m.label <> -1 then {UNITS} else 0 end as n_latent, true as in_range,
  case when m.label <> -1 then round({_squeezed(STAR.time_features)}, 6) else -999 end as squeezed_time,
  case when m.label <> -1 then round({_squeezed(STAR.count_features)}, 6) else -999 end as squeezed_count
from parts m join state t on t.month = m.month"""),
)
def _(spark, sf):
    """The latent vector of each live seat month, out of fold, and NULLs outside life."""
    states = recurrent.seat_latent_states(prep_seat_monthly(dates(spark, sf), STAR), STAR, schedule=SEATS)
    latent = F.filter(F.array(*recurrent.latent_names(UNITS)), lambda v: v.isNotNull())
    return states.select(
        "seat_id", "contract_id", "month", "split", "label", F.size(latent).alias("n_latent"), F.forall(latent, lambda v: F.abs(v) <= 1).alias("in_range"),
        *[F.round(F.coalesce(c, F.lit(-999.0)), 6).alias(c) for c in ("squeezed_time", "squeezed_count")],
    )


@query("hierarchical_recurrent", _EVALUATED_SQL)
def _(spark, sf):
    """Recurrent seats below, a recurrent model of contracts above that reads their pooled states."""
    used = dates(spark, sf)
    states = models.stage(recurrent.seat_latent_states(prep_seat_monthly(used, STAR), STAR, schedule=SEATS), "seat_states")
    table, n_features = recurrent.contract_sequences(states, used, STAR)
    return _checked(recurrent.split_scores(fit_recurrent(table, n_features, schedule=MONTHS), table))


@query("hierarchical_monthly", _EVALUATED_SQL)
def _(spark, sf):
    rows, names = _hierarchical(dates(spark, sf))
    return _evaluated(models.fit_gbt(rows, names), rows, names)


@query(
    "batch_score",
    star(f"""select l.contract_id, l.month, l.label, true as in_range
from contract_label l join ({SPLIT_SQL}) s on s.contract_id = l.contract_id where s.split = 'test' and l.label <> -1"""),
)
def _(spark, sf):
    rows = _tabular(dates(spark, sf))
    model = models.fit_logreg(rows, TABULAR)
    scored = models.scores(model, models.assemble(models.part(rows, "test"), TABULAR))
    return scored.select("contract_id", "month", "label", F.col("score").between(0, 1).alias("in_range"))


@query(
    "select_best",
    "select 'reg=0.0' as candidate, 1 as n_best, true as best_is_largest union all select 'reg=0.01', 1, true union all select 'reg=0.1', 1, true",
)
def _(spark, sf):
    rows = _tabular(dates(spark, sf))
    candidates = {f"reg={reg}": models.fit_logreg(rows, TABULAR, reg) for reg in (0.0, 0.01, 0.1)}
    chosen = models.stage(models.select_best(candidates, rows, TABULAR), "chosen")
    best = chosen.agg(
        F.struct(F.count_if("is_best").cast("int").alias("n_best"), (F.max(F.when(F.col("is_best"), F.col("auc_roc"))) == F.max("auc_roc")).alias("largest"))
    ).scalar()
    return chosen.select("candidate", best["n_best"].alias("n_best"), F.coalesce(best["largest"], F.lit(True)).alias("best_is_largest"))


def _history_checks(history: DataFrame, columns: list[str]) -> DataFrame:
    """One row per model: iterations without a gap, and losses that never rise by more than rounding."""
    step = Window.partitionBy("model").orderBy("iteration")
    marked = history.withColumns(
        {"gap": F.col("iteration") - F.row_number().over(step) + 1}
        | {f"rise_{c}": F.col(c) - F.lag(c).over(step) for c in columns}
    )
    return marked.groupBy("model").agg(
        (F.max(F.abs("gap")) == 0).alias("consecutive"),
        *[F.coalesce(F.max(f"rise_{c}") <= 1e-9, F.lit(True)).alias(f"{c}_falls") for c in columns],
    )


@query("training_history", "select 'logreg' as model, true as consecutive, true as objective_falls")
def _(spark, sf):
    rows = _tabular(dates(spark, sf))
    return _history_checks(models.training_history(spark, "logreg", models.fit_logreg(rows, TABULAR).summary.objectiveHistory), ["objective"])


@query("gbt_history", "select 'sequence' as model, true as consecutive, true as train_loss_falls")
def _(spark, sf):
    rows, names = _sequence(dates(spark, sf))
    return _history_checks(models.gbt_history(models.fit_gbt(rows, names), rows, names, "sequence"), ["train_loss"])


@query(
    "model_comparison",
    " union all ".join(f"select '{m}' as model, true as roc_in_range, true as pr_in_range" for m in ("hierarchical", "single sequence", "mlp", "logistic regression")),
)
def _(spark, sf):
    used = dates(spark, sf)
    tabular = _tabular(used)
    sequence, sequence_names = _sequence(used)
    nested, nested_names = _hierarchical(used)
    compared = model_comparison(
        {
            "hierarchical": models.test_curve(models.fit_gbt(nested, nested_names), nested, nested_names),
            "single sequence": models.test_curve(models.fit_gbt(sequence, sequence_names), sequence, sequence_names),
            "mlp": models.test_curve(models.fit_mlp(tabular, TABULAR), tabular, TABULAR),
            "logistic regression": models.test_curve(models.fit_logreg(tabular, TABULAR), tabular, TABULAR),
        }
    )
    return compared.select(
        "model", *[F.coalesce(F.col(f"auc_{k}").between(0, 1), F.lit(True)).alias(f"{k}_in_range") for k in ("roc", "pr")]
    )
