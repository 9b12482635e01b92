"""Weighted perceptron with batch normalisation and dropout, trained by Spark.

Each hidden layer is a product, a normalisation by the layer's moments, a ramp and dropout; the last layer is a sigmoid. A step
takes all train rows as its batch, so the moments and the sums that the way back through them needs are merged over all
partitions: a layer's moments are known after one scan (the first layer's without, from the features' covariances), its
gradient after another. The result does not depend on how rows are dealt over partitions.

Weights are any numbers of at least 0, in the loss and in the moments: a row of weight 2 counts as two copies of it.
Dropout is a function of the row's key, layer, unit and epoch, so a task that runs again drops the same, in every scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seatwise.training.epochs import Fitted, Schedule, train
from seatwise.training.recurrent import mixed, sigmoid
from seatwise.training.sums import Arrays, summed

# Added to variances, so that constant units stay finite.
EPSILON = 1e-3


@dataclass(frozen=True)
class PerceptronConfig:
    hidden: tuple[int, ...] = (40, 20, 10)
    dropout: float = 0.5
    seed: int = 11


Moments = list[tuple[np.ndarray, np.ndarray]]  # (mean, variance) by layer


def initial(n_features: int, config: PerceptronConfig) -> Arrays:
    rng, widths = np.random.default_rng(config.seed), [n_features, *config.hidden]
    w = {f"dense{i}": rng.normal(0, (2 / (a + b)) ** 0.5, (a, b)) for i, (a, b) in enumerate(zip(widths, widths[1:]))}
    w |= {f"gain{i}": np.ones(b) for i, b in enumerate(config.hidden)} | {f"shift{i}": np.zeros(b) for i, b in enumerate(config.hidden)}
    return w | {"output": rng.normal(0, (2 / (widths[-1] + 1)) ** 0.5, widths[-1]), "offset": np.zeros(1)}


@dataclass
class Rows:
    x: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    learn: np.ndarray
    mark: np.ndarray


def rows_of(batch: pa.RecordBatch, n_features: int) -> Rows:
    column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight", "learn", "mark")}
    x = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(n_features)])
    return Rows(x, **column)


def kept_units(mark: np.ndarray, layer: int, width: int, epoch: int, config: PerceptronConfig) -> np.ndarray:
    """What the units' outputs are multiplied by: 0 or the inverse of the share that stays."""
    seed = mixed(mark.astype(np.uint64) ^ mixed(np.full(1, epoch * 1_000_003 + layer * 7919 + config.seed, np.uint64)))
    draw = mixed(seed[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 >= config.dropout) / (1 - config.dropout)


@dataclass
class Layer:
    """What went into a layer, its normalised and its scaled sums, and what its outputs were multiplied by."""

    fed: np.ndarray
    normal: np.ndarray
    scaled: np.ndarray
    kept: np.ndarray | float


def forward(w: Arrays, moments: Moments, r: Rows, epoch: int | None, config: PerceptronConfig) -> tuple[list[Layer], np.ndarray]:
    """The layers whose ``moments`` are given, and the last one's output. Without ``epoch``, and in rows that are not learned
    from, nothing is dropped."""
    h, layers = r.x, []
    for i, (mean, variance) in enumerate(moments):
        normal = (h @ w[f"dense{i}"] - mean) / np.sqrt(variance + EPSILON)
        scaled = normal * w[f"gain{i}"] + w[f"shift{i}"]
        kept: np.ndarray | float = 1.0
        if epoch is not None and config.dropout:
            kept = np.where(r.learn[:, None], kept_units(r.mark, i, len(mean), epoch, config), 1.0)
        layers.append(Layer(h, normal, scaled, kept))
        h = np.maximum(scaled, 0) * kept
    return layers, h


def joined(*arrays: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ravel(a) for a in arrays])


def cut(flat: np.ndarray, *shapes: tuple[int, ...]) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [p.reshape(s) for p, s in zip(np.split(flat[: ends[-1]], ends[:-1]), shapes)]


class Scans:
    """What one step needs of the table; each method that takes weights is a scan, or one for each layer."""

    def __init__(self, table: DataFrame, n_features: int, config: PerceptronConfig) -> None:
        self.table, self.n, self.config = table, n_features, config
        learned = table.filter("learn and weight > 0")
        n = n_features

        def total(batch: pa.RecordBatch) -> np.ndarray:
            r = rows_of(batch, n)
            return joined(r.weight.sum(), r.weight @ r.x)

        weight, mean = cut(summed(learned, total, 1 + n), (1,), (n,))
        self.weight, self.mean = max(float(weight[0]), 1e-300), mean / max(float(weight[0]), 1e-300)
        center = self.mean

        def spread(batch: pa.RecordBatch) -> np.ndarray:
            r = rows_of(batch, n)
            d = r.x - center
            return (d.T @ (d * r.weight[:, None])).ravel()

        self.covariance = summed(learned, spread, n * n).reshape(n, n) / self.weight
        self.learned = learned

    def moments(self, w: Arrays, epoch: int) -> Moments:
        """Weighted mean and variance of each layer's sums over the train rows, with the epoch's dropout."""
        first = w["dense0"]
        found: Moments = [(self.mean @ first, np.maximum(np.einsum("ij,ik,kj->j", first, self.covariance, first), 0))]
        n, config = self.n, self.config
        for i in range(1, len(config.hidden)):
            width, below = config.hidden[i], list(found)

            def of_batch(batch: pa.RecordBatch, i=i, below=below) -> np.ndarray:
                r = rows_of(batch, n)
                z = forward(w, below, r, epoch, config)[1] @ w[f"dense{i}"]
                mean = r.weight @ z / max(r.weight.sum(), 1e-300)
                # Sums of squares around the batch's own mean lose no digits.
                return joined(r.weight @ z, r.weight @ (z - mean) ** 2, r.weight.sum() * mean * mean)

            total, within, between = cut(summed(self.learned, of_batch, 3 * width), (width,), (width,), (width,))
            mean = total / self.weight
            found.append((mean, within / self.weight + np.maximum(between / self.weight - mean * mean, 0)))
        return found

    def evaluate(self, w: Arrays, epoch: int) -> tuple[float, float, Arrays]:
        """Mean train loss, mean valid loss, and the gradient of the mean train loss, through the moments."""
        n, config, whole = self.n, self.config, self.weight
        moments = self.moments(w, epoch)
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by layer: sums of slopes, and of slopes times normalised sums
        gradient: Arrays = {}
        losses = np.zeros(4)
        top = len(config.hidden) - 1
        for i in range(top, -1, -1):
            width = config.hidden[i]
            fed_width = config.hidden[i - 1] if i else n
            shapes = [(4,), (config.hidden[-1],), (1,), (width,), (width,), (fed_width, width), (fed_width,), (fed_width, width)]

            def of_batch(batch: pa.RecordBatch, i=i, known=dict(known)) -> np.ndarray:
                r = rows_of(batch, n)
                layers, out = forward(w, moments, r, epoch, config)
                z = out @ w["output"] + w["offset"]
                loss = r.weight * (np.logaddexp(0, z) - r.label * z)
                miss = np.where(r.learn, r.weight * (sigmoid(z) - r.label), 0.0)
                used = np.where(r.learn, r.weight, 0.0)
                dh = miss[:, None] * w["output"]
                for j in range(top, i - 1, -1):
                    at = layers[j]
                    dy = dh * at.kept * (at.scaled > 0)
                    if j > i:
                        slope, turn = known[j]
                        dz = dy - used[:, None] / whole * (slope + at.normal * turn)
                        dh = (dz * (w[f"gain{j}"] / np.sqrt(moments[j][1] + EPSILON))) @ w[f"dense{j}"].T
                at, learn = layers[i], r.learn
                sums = [loss[learn].sum(), r.weight[learn].sum(), loss[~learn].sum(), r.weight[~learn].sum()]
                weighed = at.fed * used[:, None]
                return joined(sums, out.T @ miss, miss.sum(), dy.sum(axis=0), (dy * at.normal).sum(axis=0), at.fed.T @ dy, weighed.sum(axis=0), weighed.T @ at.normal)

            # Valid rows are needed for their loss only: one scan has them.
            table = self.table if i == top else self.learned
            sums, output, offset, slope, turn, plain, fed, bent = cut(summed(table, of_batch, sum(int(np.prod(s)) for s in shapes)), *shapes)
            if i == top:
                losses, gradient["output"], gradient["offset"] = sums, output, offset
            known[i] = (slope, turn)
            gradient[f"shift{i}"], gradient[f"gain{i}"] = slope, turn
            scale = w[f"gain{i}"] / np.sqrt(moments[i][1] + EPSILON)
            gradient[f"dense{i}"] = scale * (plain - np.outer(fed, slope) / whole - bent * turn / whole)
        valid = losses[2] / losses[3] if losses[3] else float("nan")
        return float(losses[0] / whole), float(valid), {k: v / whole for k, v in gradient.items()}


@dataclass(frozen=True)
class PerceptronModel:
    config: PerceptronConfig
    features: tuple[str, ...]
    moments: Moments
    fitted: Fitted

    def scored(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the probability of churn. A row with a NULL feature gets NULL."""
        # Bounded by the shape of the model.
        shared = df.sparkSession.sparkContext.broadcast((self.fitted.weights, self.moments))
        n, config, others = len(self.features), self.config, df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, moments = shared.value
            for batch in batches:
                x = np.column_stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(n)]).astype(float)
                none = np.zeros(len(x))
                out = forward(w, moments, Rows(x, none, none, none.astype(bool), none), None, config)[1]
                score = sigmoid(out @ w["output"] + w["offset"])
                columns = [batch.column(c) for c in others]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score, mask=np.isnan(x).any(axis=1))], [*others, "score"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.select("*", *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)]).mapInArrow(run, f"{fields}, score double")


def perceptron_table(rows: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """What the scans read of the train and valid rows; ``key`` names a row for dropout. Rows without a weight, or with one
    of 0, teach nothing."""
    return rows.filter(F.col("split").isin("train", "valid") & (F.col("weight") > 0)).select(
        (F.col("split") == "train").alias("learn"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"),
        F.xxhash64(*key).alias("mark"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
    )


def fit_perceptron(
    rows: DataFrame, features: Sequence[str], key: Sequence[str], config: PerceptronConfig = PerceptronConfig(), schedule: Schedule = Schedule(), path: str | None = None
) -> PerceptronModel:
    """Fit on the rows whose ``split`` is train, stopped by those whose ``split`` is valid; features must not be NULL.

    ``rows`` should be a stage table: an epoch scans it twice for each hidden layer, less one. Scores use the moments of
    the restored epoch's train rows.
    """
    scans = Scans(perceptron_table(rows, features, key), len(features), config)
    fitted = train(rows.sparkSession, initial(len(features), config), scans.evaluate, schedule, path)
    return PerceptronModel(config, tuple(features), scans.moments(fitted.weights, fitted.best_epoch), fitted)
