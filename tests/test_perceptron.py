"""The distributed perceptron against finite differences, copies of rows, other partitions and a run that was cut off."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwise.training.epochs import Schedule
from seatwise.training.perceptron import EPSILON, PerceptronConfig, Scans, fit_perceptron, initial, perceptron_table
from seatwise.workspace import new_path

FEATURES = ["a", "b", "c"]
CONFIG = PerceptronConfig(hidden=(4, 3), dropout=0.3)
SCHEMA = "id int, a double, b double, c double, label int, weight double, split string"


def data(n=90, weights=(0.5, 1.0, 2.0)):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 3)) * [1, 2, 0.5] + [0, 1, -3]
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    return [(i, *map(float, x[i]), int(y[i]), weights[i % len(weights)], ["train", "train", "train", "valid"][i % 4]) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(data(), SCHEMA).repartition(3).cache()


def scans(df, config=CONFIG):
    return Scans(perceptron_table(df, FEATURES, ["id"]), 3, config)


def test_gradient_through_the_moments_equals_finite_differences(rows):
    s, w = scans(rows), initial(3, CONFIG)
    rng = np.random.default_rng(2)
    for name in w:  # away from the symmetric start
        w[name] = w[name] + rng.normal(0, 0.1, w[name].shape)
    g = s.evaluate(w, 1)[2]
    assert set(g) == set(w)
    for name, x in w.items():
        at = np.unravel_index(rng.integers(x.size), x.shape)
        kept, found = x[at], []
        for move in (1e-5, -1e-5):
            x[at] = kept + move
            found.append(s.evaluate(w, 1)[0])
        x[at] = kept
        assert g[name][at] == pytest.approx((found[0] - found[1]) / 2e-5, abs=1e-6), name


def test_losses_equal_a_plain_computation(rows):
    config = PerceptronConfig(hidden=(4, 3), dropout=0.0)
    w = initial(3, config)
    train_loss, valid_loss, _ = scans(rows, config).evaluate(w, 0)
    learn = np.array([d[6] == "train" for d in data()])
    h, weight, label = (np.array([d[1:4] for d in data()]), np.array([d[5] for d in data()]), np.array([d[4] for d in data()]))
    for i in range(2):
        z = h @ w[f"dense{i}"]
        mean = np.average(z[learn], axis=0, weights=weight[learn])
        variance = np.average((z[learn] - mean) ** 2, axis=0, weights=weight[learn])
        h = np.maximum((z - mean) / np.sqrt(variance + EPSILON), 0)
    p = 1 / (1 + np.exp(-(h @ w["output"])))
    loss = -np.log(np.where(label == 1, p, 1 - p))
    assert train_loss == pytest.approx(np.average(loss[learn], weights=weight[learn]))
    assert valid_loss == pytest.approx(np.average(loss[~learn], weights=weight[~learn]))


def test_weight_two_equals_two_copies(spark):
    plain = data(60, weights=(1.0, 2.0, 3.0))
    copies = [(*r[:5], 1.0, r[6]) for r in plain for _ in range(int(r[5]))]
    schedule = Schedule(epochs=4, rate=0.05)
    one, other = (
        fit_perceptron(spark.createDataFrame(d, SCHEMA).repartition(k), FEATURES, ["id"], CONFIG, schedule) for d, k in ((plain, 2), (copies, 5))
    )
    assert np.allclose(one.fitted.history, other.fitted.history)
    assert all(np.allclose(v, other.fitted.weights[k], atol=1e-8) for k, v in one.fitted.weights.items())


def test_resumed_run_equals_a_whole_one(spark, rows):
    path = new_path(spark, "resumed")
    whole = fit_perceptron(rows, FEATURES, ["id"], CONFIG, Schedule(epochs=5, rate=0.05))
    fit_perceptron(rows, FEATURES, ["id"], CONFIG, Schedule(epochs=2, rate=0.05), path)
    resumed = fit_perceptron(rows, FEATURES, ["id"], CONFIG, Schedule(epochs=5, rate=0.05), path)
    assert np.allclose(whole.fitted.history, resumed.fitted.history, rtol=1e-9)
    assert all(np.allclose(v, resumed.fitted.weights[k]) for k, v in whole.fitted.weights.items())


def test_it_learns_what_no_line_separates(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    d = [(i, *map(float, x[i]), int(x[i, 0] * x[i, 1] > 0), 1.0, ["train", "train", "valid"][i % 3]) for i in range(600)]
    df = spark.createDataFrame(d, SCHEMA).repartition(2).cache()
    model = fit_perceptron(df, FEATURES, ["id"], PerceptronConfig(hidden=(16, 8), dropout=0.1), Schedule(epochs=20, rate=0.1, patience=20))
    right = model.scored(df.filter("split = 'valid'")).agg(F.avg(((F.col("score") > 0.5).cast("int") == F.col("label")).cast("int")).alias("r")).first()["r"]
    assert right > 0.85


def test_awkward_rows(spark, rows):
    """Rows of no weight teach nothing, a constant feature and a single class stay finite, NULL features score NULL, without
    valid rows the last epoch stays."""
    d = [(i, float(i), 1.0, 0.0, 0, 1.0, "train") for i in range(5)] + [(9, 1e9, 1.0, 0.0, 1, 0.0, "train"), (10, 1e9, 1.0, 0.0, 1, None, "train")]
    model = fit_perceptron(spark.createDataFrame(d, SCHEMA), FEATURES, ["id"], CONFIG, Schedule(epochs=3))
    assert model.fitted.best_epoch == 2 and all(np.isfinite(v).all() for v in model.fitted.weights.values())
    asked = spark.createDataFrame([(1, 1.0, 1.0, 0.0), (2, None, 1.0, 0.0)], "id int, a double, b double, c double")
    found = {r["id"]: r["score"] for r in model.scored(asked).collect()}
    assert 0 <= found[1] <= 1 and found[2] is None
    assert model.scored(asked.limit(0)).columns == ["id", "a", "b", "c", "score"] and model.scored(asked.limit(0)).count() == 0
    empty = fit_perceptron(rows.limit(0), FEATURES, ["id"], CONFIG, Schedule(epochs=2))
    assert all(np.isfinite(v).all() for v in empty.fitted.weights.values())
