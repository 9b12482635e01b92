"""Churn classifiers on seat months and contract months, trained and scored by Spark ML.

The per-month recurrent models are re-expressed as boosted trees over history features: what a month
knows of the past is computed by windows instead of a hidden state.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seatwise.config import ChurnConfig
from seatwise.functions.vectors import encode_missing, total
from seatwise.operators.evaluate import areas, confusion_curve, filter_scored
from seatwise.operators.pool import pooled_names
from seatwise.operators.scale import apply_std_scaler, fit_std_scaler
from seatwise.operators.split import split_of
from seatwise.plans.prep import prep_group_daily, prep_pooled
from seatwise.workspace import stage, use_checkpoints

SHARES = {"train": 0.6, "valid": 0.2, "test": 0.2}
SEED = "churn"
# Another seed, so that folds do not follow the split.
FOLD_SEED = "fold"
N_FOLDS = 3
# How far back a month and a day look.
MONTH_LAGS = (1, 2)
DAY_LAGS = (7, 30)
# Widths of the hidden layers of the perceptron.
HIDDEN = (40, 20, 10)


def with_split(df: DataFrame, shares: Mapping[str, float] = SHARES, seed: str = SEED) -> DataFrame:
    """Add the contract's split; computed from the id, so nothing is joined."""
    return df.withColumn("split", split_of(F.col("contract_id"), shares, seed))


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``features``, the columns as one vector; a table from ``stage_assembled`` has it already."""
    if "features" in df.columns:
        return df
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(df)


def stage_assembled(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """A stage table with ``features`` beside ``columns``: boosted trees scan their input many times, and to put a vector
    together from many columns takes longer than all else in a scan."""
    return stage(assemble(df, columns), name)


def scale_months(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale by the training rows of the same month."""
    state = fit_std_scaler(df.filter(F.col("split") == "train"), features)
    return apply_std_scaler(df, state, features)


def encode_features(df: DataFrame, features: Sequence[str], cfg: ChurnConfig) -> DataFrame:
    return df.withColumns({f: encode_missing(F.col(f), float(cfg.missing_value)) for f in features})


def scaled_split(prep: DataFrame, features: Sequence[str], cfg: ChurnConfig) -> DataFrame:
    """Month rows inside life with split, scaled and encoded features, ready for ``assemble``.

    Two stage tables: the months, which the scaler reads twice, and the result, which the trainers pass
    over many times.
    """
    months = stage(with_split(prep), "months")
    scaled = encode_features(scale_months(months, features), features, cfg)
    return stage(filter_scored(scaled), "model_input")


def part(df: DataFrame, split: str) -> DataFrame:
    return df.filter(F.col("split") == split)


def scores(model, df: DataFrame) -> DataFrame:
    """Add ``score``, the probability of churn."""
    if isinstance(model, LogisticRegressionModel) and model.hasSummary:
        # The summary holds the session, which can't go to tasks once ``observe`` has been used in it.
        model = model.copy()
        model._java_obj.setSummary(df.sparkSession._jvm.scala.Option.empty())
    scored = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return scored.drop("probability", "rawPrediction", "prediction")


# ---- baselines --------------------------------------------------------------------------------


def fit_logreg(
    split: DataFrame, features: Sequence[str], reg: float = 0.0, iterations: int = 100, tolerance: float = 1e-6
) -> LogisticRegressionModel:
    """Weighted logistic regression on the months of all contracts. It has converged if its history is shorter than
    ``iterations`` + 1."""
    trainer = LogisticRegression(weightCol="weight", standardization=False, regParam=reg, maxIter=iterations, tol=tolerance)
    return trainer.fit(assemble(part(split, "train"), features))


def fit_mlp(
    split: DataFrame, features: Sequence[str], hidden: Sequence[int] = HIDDEN, iterations: int = 100
) -> MultilayerPerceptronClassificationModel:
    """Multilayer perceptron. It takes no weights, so a row of weight w is given w times; w must be whole and positive."""
    weight = F.col("weight")
    if not part(split, "train").filter((weight < 1) | (weight != F.floor(weight)) | weight.isNull()).isEmpty():
        raise ValueError("weights of a perceptron's rows must be whole numbers of at least 1")
    copies = F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))).alias("_copy")
    train = assemble(part(split, "train"), features).select("features", "label", copies)
    trainer = MultilayerPerceptronClassifier(
        layers=[len(features), *hidden, 2], maxIter=iterations, seed=11, blockSize=128
    )
    return trainer.fit(train.drop("_copy"))


# ---- sequence models --------------------------------------------------------------------------


def history_names(features: Sequence[str], lags: Sequence[int] = MONTH_LAGS) -> list[str]:
    names = [f"lag{k}_{f}" for k in lags for f in features]
    names += [f"{kind}_so_far_{f}" for kind in ("mean", "max") for f in features]
    names += [f"delta_{f}" for f in features]
    return [*features, *names, "steps_alive", "steps_since_use"]


def history_features(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    use: str,
    lags: Sequence[int] = MONTH_LAGS,
    step: str = "month",
) -> DataFrame:
    """What each step knows of the steps before it in the same life.

    Lags, mean and maximum so far, change since the previous step, steps alive, and steps since ``use``
    was last above 0 (since the start if never). A key has at most one row per step of the horizon.
    """
    by_step = Window.partitionBy(key).orderBy(step)
    so_far = by_step.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {}
    for f in features:
        for k in lags:
            columns[f"lag{k}_{f}"] = F.coalesce(F.lag(f, k).over(by_step), F.lit(0.0))
        columns[f"mean_so_far_{f}"] = F.avg(f).over(so_far)
        columns[f"max_so_far_{f}"] = F.max(f).over(so_far)
        columns[f"delta_{f}"] = F.col(f) - F.coalesce(F.lag(f).over(by_step), F.col(f))
    first = F.min(step).over(so_far)
    last_use = F.max(F.when(F.col(use) > 0, F.col(step))).over(so_far)
    columns["steps_alive"] = F.col(step) - first
    columns["steps_since_use"] = F.col(step) - F.coalesce(last_use, first)
    return df.withColumns(columns)


def fit_gbt(
    rows: DataFrame, features: Sequence[str], weighted: bool = True, iterations: int = 10
) -> GBTClassificationModel:
    """Boosted trees on the train rows, stopped by the loss on the valid rows."""
    use_checkpoints(rows.sparkSession)
    options = {"weightCol": "weight"} if weighted else {}
    trainer = GBTClassifier(
        maxIter=iterations, maxDepth=3, stepSize=0.2, seed=11, subsamplingRate=1.0, minInstancesPerNode=5,
        validationIndicatorCol="is_valid", validationTol=0.001, **options,
    )
    learn = rows.filter(F.col("split").isin("train", "valid")).withColumn("is_valid", F.col("split") == "valid")
    return trainer.fit(assemble(learn, features))


def sequence_input(prep: DataFrame, features: Sequence[str], cfg: ChurnConfig, key: str, use: Column) -> DataFrame:
    """Scaled months inside life with their history features as one vector, as a stage table.

    ``use`` is above 0 in months with use; it is taken before scaling.
    """
    months = stage(with_split(prep).withColumn("_use", use), "months")
    scaled = filter_scored(encode_features(scale_months(months, features), features, cfg))
    return stage_assembled(history_features(scaled, key, features, "_use").drop("_use"), history_names(features), "sequence_input")


def daily_group_input(dates: DataFrame, cfg: ChurnConfig) -> tuple[DataFrame, list[str]]:
    """Contract days with presence of the seats and its history; only the days that carry a label.

    Days need no scaling: presence is a share, and the seat count is all there is beside it.
    """
    presence = ["alive"]
    features = [*pooled_names(presence), "n_seats"]
    days = with_split(prep_group_daily(dates, presence, cfg))
    days = days.withColumns({f: F.col(f).cast("double") for f in features})
    rows = history_features(days, "contract_id", features, "max_alive", DAY_LAGS, "day")
    labelled = rows.filter(F.col("weight") != 0).withColumn("weight", F.col("weight").cast("double"))
    names = history_names(features, DAY_LAGS)
    return stage_assembled(labelled, names, "daily_input"), names


# ---- two stages: seats, then contracts ----------------------------------------------------------


def seat_stage_scores(seat_rows: DataFrame, cfg: ChurnConfig, weighted: bool = False) -> DataFrame:
    """Stage 1: per seat month the squeezed features and what a seat-level sequence model says.

    ``latent_margin`` and ``latent_score`` stand for the hidden state. Train contracts are scored out of
    fold, so that stage 2 does not learn from scores that have seen their own labels. Months outside life
    are kept, with NULLs. ``seat_rows`` is the output of ``prep_seat_monthly``.
    """
    features = cfg.features
    months = with_split(seat_rows).withColumn("_use", total(cfg.count_features))
    scaled = scale_months(stage(months, "seat_months"), features)
    live = encode_features(filter_scored(scaled), features, cfg)
    fold = F.pmod(F.xxhash64(F.lit(FOLD_SEED), "contract_id"), F.lit(N_FOLDS))
    live = live.withColumns(
        {
            "squeezed_time": total(cfg.time_features),
            "squeezed_count": total(cfg.count_features),
            "fold": fold.cast("int"),
        }
    )
    names = history_names(features)
    rows = stage(assemble(history_features(live, "seat_id", features, "_use"), names).drop(*names), "seat_sequence_input")

    parts = []
    train = F.col("split") == "train"
    for k in range(N_FOLDS):
        model = fit_gbt(rows.filter(~train | (F.col("fold") != k)), names, weighted)
        parts.append((model, rows.filter(train & (F.col("fold") == k))))
    parts.append((fit_gbt(rows, names, weighted), rows.filter(~train)))

    keep = ["seat_id", "contract_id", "month", "split", "label", "squeezed_time", "squeezed_count"]
    latent = ["latent_margin", "latent_score"]
    result = filter_masked(scaled).select(
        "seat_id", "contract_id", "month", "split", "label",
        *[F.lit(None).cast("double").alias(c) for c in ["squeezed_time", "squeezed_count", *latent]],
    )
    for model, part_rows in parts:
        scored = model.transform(assemble(part_rows, names)).select(
            *keep,
            vector_to_array("rawPrediction")[1].alias("latent_margin"),
            vector_to_array("probability")[1].alias("latent_score"),
        )
        result = result.unionByName(scored)
    return result


def filter_masked(df: DataFrame) -> DataFrame:
    """The months outside life."""
    return df.filter(F.col("label") == -1)


LATENT = ["squeezed_time", "squeezed_count", "latent_margin", "latent_score"]


def hierarchical_input(seat_scores: DataFrame, dates: DataFrame, cfg: ChurnConfig) -> tuple[DataFrame, list[str]]:
    """Stage 2 input: seat scores pooled by contract, scaled, with history features."""
    pooled = prep_pooled(seat_scores, dates, LATENT, cfg)
    features = [*pooled_names(LATENT), "n_seats"]
    rows = sequence_input(pooled, features, cfg, "contract_id", F.col("max_squeezed_count"))
    return rows, history_names(features)


# ---- evaluation ---------------------------------------------------------------------------------


def test_curve(model, rows: DataFrame, features: Sequence[str], split: str = "test") -> DataFrame:
    """Confusion curve of a model on the rows of one split."""
    return confusion_curve(scores(model, assemble(part(rows, split), features)))


def select_best(candidates: Mapping[str, object], rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(candidate, auc_roc, auc_pr, is_best)`` on the valid rows; the best has the largest ROC area."""
    table = None
    for name, model in candidates.items():
        curve = test_curve(model, rows, features, "valid")
        row = areas(curve).withColumn("candidate", F.lit(name))
        table = row if table is None else table.unionByName(row)
    # One row per candidate.
    rank = F.row_number().over(Window.orderBy(F.desc("auc_roc"), "candidate"))
    return table.select("candidate", "auc_roc", "auc_pr", (rank == 1).alias("is_best"))


def training_history(spark: SparkSession, model: str, objective: Sequence[float], name: str = "objective") -> DataFrame:
    """``(model, iteration, name)``: one row per training iteration."""
    rows = [(model, i, float(v)) for i, v in enumerate(objective)]
    return spark.createDataFrame(rows, f"model string, iteration int, {name} double")


def gbt_history(model: GBTClassificationModel, rows: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """Train and valid loss after each tree."""
    spark = rows.sparkSession
    loss = {
        split: model.evaluateEachIteration(assemble(part(rows, split), features).withColumn("label", F.col("label").cast("double")))
        for split in ("train", "valid")
    }
    train = training_history(spark, name, loss["train"], "train_loss")
    valid = training_history(spark, name, loss["valid"], "valid_loss")
    return train.join(valid, ["model", "iteration"])
