"""Distributed training against finite differences, plain loops, uninterrupted runs and Spark ML."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seatwise.plans import models
from seatwise.training import epochs, recurrent
from seatwise.training.epochs import Schedule
from seatwise.training.newton import fit_newton
from seatwise.training.recurrent import RecurrentConfig, fit_recurrent, loss_and_gradient, staged_sequences
from seatwise.training.sums import packed, summed, unpacked
from seatwise.workspace import new_path

CONFIG = RecurrentConfig(units=3, dropout=0.4, batch=4)


def table(seed=0, n=9, n_features=2, steps=6):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, steps + 1, n)
    rows = [
        {"mark": int(rng.integers(-(2**62), 2**62)), "split": ["train", "train", "valid"][i % 3], "steps": sorted(rng.choice(20, k, replace=False).tolist()),
         "x": rng.normal(size=k * n_features).tolist(), "label": rng.integers(0, 2, k).astype(float).tolist(), "weight": rng.uniform(0, 3, k).tolist()}
        for i, k in enumerate(lengths.tolist())
    ]
    return pa.RecordBatch.from_pylist(rows, pa.schema([("mark", pa.int64()), ("split", pa.string()), ("steps", pa.list_(pa.int32())), *[(c, pa.list_(pa.float64())) for c in ("x", "label", "weight")]]))


def total(w, arrow, config, epoch=2):
    sums, grads = np.zeros(4), None
    for b in recurrent.batches(arrow, 2, config.batch):
        s, g = loss_and_gradient(w, b, epoch, config)
        sums, grads = sums + s, g if grads is None else {k: grads[k] + g[k] for k in g}
    return sums, grads


@pytest.mark.parametrize("dropout", [0.0, 0.4])
def test_gradient_equals_finite_differences(dropout):
    config, arrow = RecurrentConfig(units=3, dropout=dropout, batch=4), table()
    w = recurrent.initial(2, config)
    _, g = total(w, arrow, config)
    rng = np.random.default_rng(1)
    for name, x in w.items():
        for at in [np.unravel_index(i, x.shape) for i in rng.integers(0, x.size, 8)]:
            kept = x[at]
            x[at] = kept + 1e-6
            more = total(w, arrow, config)[0][0]
            x[at] = kept - 1e-6
            less = total(w, arrow, config)[0][0]
            x[at] = kept
            assert g[name][at] == pytest.approx((more - less) / 2e-6, abs=1e-5), name


def test_loss_equals_a_plain_loop():
    """One sequence after the other, without batches or filling up; valid sequences without dropout."""
    config, arrow = RecurrentConfig(units=3, dropout=0.0, batch=4), table(3)
    w = recurrent.initial(2, config)
    s = (lambda v: 1 / (1 + math.exp(-v)))
    expected = np.zeros(4)
    for row in arrow.to_pylist():
        c, h = np.zeros(3), np.zeros(3)
        for t in range(len(row["steps"])):
            z = np.array(row["x"][2 * t : 2 * t + 2]) @ w["input"] + h @ w["hidden"] + w["bias"]
            take, keep, new, show = z[:3], z[3:6], np.tanh(z[6:9]), z[9:]
            c = np.array([s(v) for v in keep]) * c + np.array([s(v) for v in take]) * new
            h = np.array([s(v) for v in show]) * np.tanh(c)
            p = s(float(h @ w["output"] + w["offset"][0]))
            loss = -row["weight"][t] * math.log(p if row["label"][t] else 1 - p)
            expected[0 if row["split"] == "train" else 2] += loss
            expected[1 if row["split"] == "train" else 3] += row["weight"][t]
    assert total(w, arrow, config)[0] == pytest.approx(expected)


def test_truncation_keeps_the_loss_and_cuts_the_gradient():
    arrow = table(4, steps=8)
    w = recurrent.initial(2, CONFIG)
    whole, cut, long = (total(w, arrow, RecurrentConfig(units=3, dropout=0.0, batch=4, truncate=k)) for k in (0, 2, 50))
    assert cut[0] == pytest.approx(whole[0])
    assert all(np.allclose(long[1][k], whole[1][k]) for k in w)
    assert np.allclose(cut[1]["output"], whole[1]["output"]) and not np.allclose(cut[1]["hidden"], whole[1]["hidden"])


def test_dropout_depends_on_sequence_step_and_epoch_only():
    arrow = table(5)
    w = recurrent.initial(2, CONFIG)
    one = total(w, arrow, CONFIG)
    other = total(w, arrow.take(pa.array(range(arrow.num_rows)[::-1])), RecurrentConfig(units=3, dropout=0.4, batch=2))
    assert one[0] == pytest.approx(other[0]) and all(np.allclose(one[1][k], other[1][k]) for k in w)
    assert total(w, arrow, CONFIG, epoch=3)[0][0] != pytest.approx(one[0][0])


@pytest.fixture(scope="module")
def rows(spark):
    """The label of a step is whether the feature was high two steps before: only a memory can know."""
    rng = np.random.default_rng(7)
    data = []
    for k in range(150):
        x = rng.normal(size=8)
        for t in range(8):
            data.append((f"k{k}", t + k % 3, float(x[t]), 1.0, int(t >= 2 and x[t - 2] > 0), float(1 + k % 2), ["train", "train", "valid", "test"][k % 4]))
    return spark.createDataFrame(data, "id string, month int, a double, b double, label int, weight double, split string").repartition(5)


def test_learns_from_the_past(rows):
    sequences = staged_sequences(rows, "id", "month", ["a", "b"])
    model = fit_recurrent(sequences, 2, RecurrentConfig(units=6, dropout=0.0), Schedule(epochs=60, rate=0.08, patience=60))
    losses = [h[2] for h in model.fitted.history]
    assert losses[model.fitted.best_epoch] == min(losses) < 0.75 * losses[0]
    states = model.states(sequences)
    assert states.count() == rows.count() and states.filter("size(latent) <> 6 or not score between 0 and 1").count() == 0
    # What the model says at the best epoch is what its history says.
    z = F.when(F.col("label") == 1, -F.log("score")).otherwise(-F.log(1 - F.col("score")))
    loss = states.filter("split = 'valid'").agg((F.sum(F.col("weight") * z) / F.sum("weight")).alias("l")).first()["l"]
    assert loss == pytest.approx(min(losses))


def test_patience_and_a_run_that_goes_on(spark, rows):
    sequences = staged_sequences(rows, "id", "month", ["a", "b"])
    config = RecurrentConfig(units=3, dropout=0.3)
    whole = fit_recurrent(sequences, 2, config, Schedule(epochs=7, rate=0.05))
    path = new_path(spark, "epochs")
    fit_recurrent(sequences, 2, config, Schedule(epochs=3, rate=0.05), path)
    resumed = fit_recurrent(sequences, 2, config, Schedule(epochs=7, rate=0.05), path)
    assert resumed.fitted.history == whole.fitted.history and resumed.fitted.best_epoch == whole.fitted.best_epoch
    assert all(np.array_equal(resumed.fitted.weights[k], whole.fitted.weights[k]) for k in whole.fitted.weights)


def test_patience_ends_a_run_and_the_best_epoch_counts(spark):
    losses = [5.0, 3.0, 2.0, 2.5, 2.0, 2.2, 1.0]
    seen = []

    def evaluate(weights, epoch):
        seen.append((epoch, weights["w"].copy()))
        return 0.0, losses[epoch], {"w": np.ones(2)}

    fitted = epochs.train(spark, {"w": np.zeros(2)}, evaluate, Schedule(epochs=10, rate=0.1, patience=3))
    assert fitted.best_epoch == 2 and [h[0] for h in fitted.history] == [0, 1, 2, 3, 4, 5]
    assert np.array_equal(fitted.weights["w"], seen[2][1])


def test_sums_in_a_tree(spark):
    df = spark.range(1000).repartition(40)

    def of_batch(batch):
        return np.array([batch.num_rows, sum(batch.column("id").to_pylist())], float)

    assert summed(df, of_batch, 2, fan_in=3).tolist() == [1000, 499500]
    assert summed(df.filter("id < 0"), of_batch, 2).tolist() == [0, 0]
    arrays = {"b": np.arange(6.0).reshape(2, 3), "a": np.ones(1)}
    assert all(np.array_equal(v, unpacked(packed(arrays), arrays)[k]) for k, v in arrays.items())


@pytest.fixture(scope="module")
def flat(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    p = 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] - 0.3)))
    data = [(*map(float, x[i]), int(rng.uniform() < p[i]), float(1 + i % 3) / 2, ["train", "train", "valid"][i % 3]) for i in range(400)]
    return spark.createDataFrame(data, "a double, b double, c double, label int, weight double, split string").repartition(3)


def test_newton_agrees_with_spark_ml(flat):
    names = ["a", "b", "c"]
    model, other = fit_newton(flat, names, penalty=0.0), models.fit_logreg(flat, names, iterations=500, tolerance=1e-12)
    assert model.converged
    assert model.coefficients == pytest.approx(other.coefficients.toArray(), abs=1e-5) and model.intercept == pytest.approx(other.intercept, abs=1e-5)
    assert all(after[1] <= before[1] + 1e-12 for before, after in zip(model.history, model.history[1:]))
    z = F.when(F.col("label") == 1, -F.log("score")).otherwise(-F.log(1 - F.col("score")))
    for split, place in (("train", 1), ("valid", 2)):
        loss = model.scored(flat).filter(F.col("split") == split).agg((F.sum(F.col("weight") * z) / F.sum("weight")).alias("l")).first()["l"]
        assert loss == pytest.approx(model.history[-1][place])


def test_newton_with_a_constant_feature_and_separable_rows(spark):
    data = [(float(i), 1.0, int(i > 4), 1.0, "train") for i in range(10)]
    model = fit_newton(spark.createDataFrame(data, "a double, b double, label int, weight double, split string"), ["a", "b"], penalty=1e-3)
    assert model.converged and np.isfinite(model.coefficients).all() and math.isnan(model.history[0][2])


def test_seat_states_are_out_of_fold(spark):
    """Each live seat month has one vector, months outside life none; a contract's fold is not in its own model."""
    from registry.core import dates
    from seatwise.fixtures import STAR
    from seatwise.plans import recurrent as plans
    from seatwise.plans.prep import prep_seat_monthly
    from seatwise.workspace import stage

    used = dates(spark, "/root/testdata/sf0.001")
    seat_rows = stage(prep_seat_monthly(used, STAR), "seat_rows")
    seen = []
    fit = plans.fit_recurrent

    def watched(table, n, config, schedule, learn):
        seen.append({r.fold for r in table.filter(learn & (F.col("split") == "train")).select(plans._fold(F.col("contract_id")).alias("fold")).distinct().collect()})
        return fit(table, n, config, schedule, learn=learn)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(plans, "fit_recurrent", watched)
        states = stage(plans.seat_latent_states(seat_rows, STAR, RecurrentConfig(units=4), Schedule(epochs=2)), "states")
    assert all(k not in folds for k, folds in enumerate(seen[:3])) and seen[3] == set.union(*seen[:3])
    assert states.count() == seat_rows.count() == states.select("seat_id", "month").distinct().count()
    whole = " and ".join(f"latent_{i} is not null" for i in range(4))
    none = " and ".join(f"latent_{i} is null" for i in range(4))
    assert states.filter(f"label <> -1 and not ({whole}) or label = -1 and not ({none})").count() == 0
    table, n = plans.contract_sequences(states, used, STAR, 4)
    assert n == 19 and table.selectExpr("max(size(x) / size(steps)) as a", "min(size(x) / size(steps)) as b").first() == (19, 19)


def test_seat_days_are_sequences_of_life(spark):
    """One step for each live day in order, the contract's split, features of deviation 1 over train days."""
    from registry.core import dates
    from seatwise.fixtures import STAR
    from seatwise.plans import recurrent as plans
    from seatwise.plans.models import with_split
    from seatwise.plans.prep import prep_seat_daily
    from seatwise.workspace import stage

    used = dates(spark, "/root/testdata/sf0.001")
    table = plans.seat_day_sequences(used, STAR)
    live = stage(prep_seat_daily(used, STAR).filter("label <> -1"), "live")
    steps = table.select("seat_id", F.explode(F.arrays_zip("steps", "label")).alias("s")).select("seat_id", "s.steps", F.col("s.label").cast("int").alias("label"))
    assert steps.exceptAll(live.select("seat_id", "day", "label")).isEmpty() and steps.count() == live.count()
    assert table.filter("not forall(sequence(1, size(steps) - 1), i -> i = 0 or steps[i] > steps[i - 1])").isEmpty()
    assert table.filter(f"size(x) <> {len(STAR.features)} * size(steps)").isEmpty()
    split = with_split(used.select("seat_id", "contract_id").distinct()).select("seat_id", "split")
    assert table.select("seat_id", "split").exceptAll(split).isEmpty()
    flat = np.array([v for r in table.filter("split = 'train'").select("x").collect() for v in r.x]).reshape(-1, len(STAR.features))
    used_ones = flat.std(axis=0)[(flat != -1).any(axis=0)]
    assert used_ones.size and np.allclose(used_ones, 1)


def test_seat_days_equal_the_dense_days(spark):
    """Steps, features and labels are those of the daily table, which the sequences are not made of: no table of days is staged."""
    from registry.core import dates
    from seatwise.fixtures import STAR
    from seatwise.plans import recurrent as plans
    from seatwise.plans.models import with_split
    from seatwise.plans.prep import prep_seat_daily
    from seatwise.workspace import stage

    used, staged = dates(spark, "/root/testdata/sf0.001"), []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(plans, "stage", lambda df, name: staged.append((name, stage(df, name))) or staged[-1][1])
        table = plans.seat_day_sequences(used, STAR)
    live = stage(prep_seat_daily(used, STAR).filter("label <> -1"), "live").join(with_split(used.select("seat_id", "contract_id").distinct()), "seat_id").toPandas()
    deviation = live[live.split == "train"][STAR.features].astype(float).std(ddof=0)
    assert staged[0][1].count() < len(live)
    got = {r.seat_id: r for r in table.collect()}
    assert set(got) == set(live.seat_id)
    for seat, rows in live.sort_values("day").groupby("seat_id"):
        x = rows[STAR.features].astype(float).to_numpy()
        with np.errstate(all="ignore"):
            x = np.where(deviation.to_numpy() == 0, -1, np.nan_to_num(x / deviation.to_numpy(), nan=-1))
        r = got[seat]
        assert r.steps == rows.day.tolist() and r.label == rows.label.tolist() and r.weight == [1.0] * len(rows)
        assert np.allclose(np.array(r.x).reshape(len(rows), -1), x)
