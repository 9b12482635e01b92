"""Masked recurrent classifier over sequences of steps: one layer of memory cells, dropout, a sigmoid at each step.

The table has one row for each sequence, with its live steps in order; steps outside life are not in it, so the memory passes
over them. A task takes its sequences in batches of a bounded number, longest first, runs them forward and back in numpy, and
adds up losses and gradients; Spark adds the tasks' sums, and the driver takes the step.

``truncate`` cuts the way back into spans of that many steps: memory goes on over the cut, gradients do not.
Dropout is a function of the sequence, step, unit and epoch, so a task that runs again drops the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seatwise.training.epochs import Fitted, Schedule, train
from seatwise.training.sums import Arrays, packed, summed, unpacked
from seatwise.workspace import stage


@dataclass(frozen=True)
class RecurrentConfig:
    """``batch`` sequences and their longest length bound what a task holds. ``truncate`` 0 goes all the way back."""

    units: int = 20
    dropout: float = 0.5
    truncate: int = 0
    batch: int = 256
    seed: int = 11


def sequences(rows: DataFrame, key: str, step: str, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(key, split, keep…, mark, steps, x, label, weight)``, one row per ``key``, its rows in the order of ``step``.

    A key has at most one row for each step of the horizon. Features must not be NULL; ``keep`` are columns that are the
    same in all rows of a key.
    """
    x = F.array(*[F.col(f).cast("double") for f in features])
    item = F.struct(F.col(step).cast("int").alias("step"), x.alias("x"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))
    packed_rows = rows.groupBy(key, "split", *keep).agg(F.array_sort(F.collect_list(item)).alias("s"))
    return packed_rows.select(
        key, "split", *keep, F.xxhash64(key).alias("mark"), F.col("s.step").alias("steps"), F.flatten("s.x").alias("x"),
        F.col("s.label").alias("label"), F.col("s.weight").alias("weight"),
    )


def initial(n_features: int, config: RecurrentConfig) -> Arrays:
    rng, h = np.random.default_rng(config.seed), config.units
    bias = np.zeros(4 * h)
    bias[h : 2 * h] = 1  # gates that keep the memory begin open
    return {
        "input": rng.normal(0, (2 / (n_features + h)) ** 0.5, (n_features, 4 * h)), "hidden": rng.normal(0, h**-0.5, (h, 4 * h)) * 0.5,
        "bias": bias, "output": rng.normal(0, (2 / (h + 1)) ** 0.5, h), "offset": np.zeros(1),
    }


@dataclass
class Batch:
    """Sequences filled up to the longest: features, labels, weights, steps; ``lengths`` from long to short."""

    x: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    steps: np.ndarray
    lengths: np.ndarray
    mark: np.ndarray
    learn: np.ndarray
    rows: np.ndarray  # places in the Arrow batch


def batches(batch: pa.RecordBatch, n_features: int, size: int) -> Iterator[Batch]:
    """Packed by length, so that short sequences are not filled up to the longest of all."""
    columns = {c: batch.column(c) for c in ("steps", "x", "label", "weight")}
    lengths = np.diff(columns["steps"].offsets.to_numpy())
    order = np.argsort(-lengths, kind="stable")
    flat = {c: np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64) for c, v in columns.items()}
    starts = np.cumsum(lengths) - lengths
    mark, learn = batch.column("mark").to_numpy(), np.array(batch.column("split").to_pylist()) == "train"
    for first in range(0, len(order), size):
        rows = order[first : first + size]
        n, longest = lengths[rows], int(lengths[rows].max())
        there = np.arange(longest) < n[:, None]
        at = (starts[rows][:, None] + np.arange(longest))[there]
        values = {c: np.zeros(there.shape) for c in ("steps", "label", "weight")}
        for c, v in values.items():
            v[there] = flat[c][at]
        x = np.zeros((*there.shape, n_features))
        x[there] = flat["x"].reshape(-1, n_features)[at]
        yield Batch(x, values["label"], values["weight"], values["steps"].astype(np.int64), n, mark[rows], learn[rows], rows)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kept_units(b: Batch, epoch: int, config: RecurrentConfig) -> np.ndarray:
    """What the units' outputs at all places, the places first, are multiplied by: 0 or the inverse of the share that stays."""
    seed = mixed(b.mark.astype(np.uint64) ^ mixed(b.steps.T.astype(np.uint64) + np.uint64(epoch * 1_000_003 + config.seed)))
    draw = mixed(seed[..., None] + np.arange(1, config.units + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    share = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return (share >= config.dropout) / (1 - config.dropout)


def forward(w: Arrays, b: Batch) -> dict[str, np.ndarray]:
    """Gates, memory and outputs of all places; sequences that have ended keep their last state."""
    n, longest, _ = b.x.shape
    h = w["output"].size
    fed = np.ascontiguousarray(b.x.transpose(1, 0, 2)) @ w["input"] + w["bias"]
    gates, memory, out = np.zeros((longest, n, 4 * h)), np.zeros((longest + 1, n, h)), np.zeros((longest + 1, n, h))
    bent = np.zeros((longest, n, h))
    lives = (np.arange(longest)[:, None] < b.lengths).sum(axis=1).tolist()  # the longest come first
    # One tanh for all gates: a sigmoid is half of the tanh of half, plus a half.
    half = np.repeat([0.5, 0.5, 1.0, 0.5], h)
    shift = 1 - half
    for t, live in enumerate(lives):
        z = fed[t, :live] + out[t, :live] @ w["hidden"]
        z *= half
        np.tanh(z, out=z)
        z *= half
        z += shift
        gates[t, :live] = z
        if live < n:
            memory[t + 1, live:], out[t + 1, live:] = memory[t, live:], out[t, live:]
        memory[t + 1, :live] = z[:, h : 2 * h] * memory[t, :live] + z[:, :h] * z[:, 2 * h : 3 * h]
        np.tanh(memory[t + 1, :live], out=bent[t, :live])
        out[t + 1, :live] = z[:, 3 * h :] * bent[t, :live]
    return {"gates": gates, "memory": memory, "out": out, "bent": bent}


def loss_and_gradient(w: Arrays, b: Batch, epoch: int, config: RecurrentConfig) -> tuple[np.ndarray, Arrays]:
    """Sums of (train loss, train weight, valid loss, valid weight), and the gradient of the train loss's sum."""
    f, h = forward(w, b), w["output"].size
    g = {k: np.zeros_like(v) for k, v in w.items()}
    longest = b.x.shape[1]
    there = np.arange(longest)[:, None] < b.lengths  # the places first, as in the gates
    # Only the way back goes place by place; what a place has of its own is computed for all places at once.
    kept = np.where(b.learn[:, None], kept_units(b, epoch, config), 1.0) if config.dropout else 1.0
    shown = f["out"][1:] * kept
    z = shown @ w["output"] + w["offset"]
    label, weight = b.label.T, np.where(there, b.weight.T, 0.0)
    loss = weight * (np.logaddexp(0, z) - label * z)
    learn = b.learn
    sums = np.array([loss[:, learn].sum(), weight[:, learn].sum(), loss[:, ~learn].sum(), weight[:, ~learn].sum()])
    slope = np.where(learn, weight * (sigmoid(z) - label), 0.0)
    g["output"], g["offset"] = slope.ravel() @ shown.reshape(-1, h), np.array([slope.sum()])
    own = slope[..., None] * w["output"] * kept
    take, keep, new, show = (f["gates"][:, :, i * h : (i + 1) * h] for i in range(4))
    bent = f["bent"]
    into = show * (1 - bent * bent)
    # A gate's slope is the slope of the memory, or of the output for the last one, times these.
    by_take, by_keep = new * take * (1 - take), f["memory"][:-1] * keep * (1 - keep)
    by_new, by_show = take * (1 - new * new), bent * show * (1 - show)
    back = np.ascontiguousarray(w["hidden"].T)
    dh, dc, dz = np.zeros((len(b.lengths), h)), np.zeros((len(b.lengths), h)), np.zeros_like(f["gates"])
    lives = there.sum(axis=1)
    for t in reversed(range(longest)):
        live = int(lives[t])
        if config.truncate and (t + 1) % config.truncate == 0:
            dh[:], dc[:] = 0, 0
        out = dh[:live] + own[t, :live]
        memory = dc[:live] + out * into[t, :live]
        at = dz[t, :live]
        np.multiply(memory, by_take[t, :live], out=at[:, :h])
        np.multiply(memory, by_keep[t, :live], out=at[:, h : 2 * h])
        np.multiply(memory, by_new[t, :live], out=at[:, 2 * h : 3 * h])
        np.multiply(out, by_show[t, :live], out=at[:, 3 * h :])
        dh[:live], dc[:live] = at @ back, memory * keep[t, :live]
    flat = dz.reshape(-1, 4 * h)
    g["hidden"] = f["out"][:-1].reshape(-1, h).T @ flat
    g["input"], g["bias"] = b.x.transpose(1, 0, 2).reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
    return sums, g


@dataclass(frozen=True)
class RecurrentModel:
    config: RecurrentConfig
    n_features: int
    fitted: Fitted

    def states(self, table: DataFrame) -> DataFrame:
        """Every step of the sequences: the table's other columns, ``step``, ``label``, ``weight``, ``score`` and ``latent``, the
        layer's output (without dropout)."""
        others = [c for c in table.columns if c not in ("mark", "steps", "x", "label", "weight")]
        # Bounded by the shape of the model.
        shared = table.sparkSession.sparkContext.broadcast(self.fitted.weights)
        n_features, size = self.n_features, self.config.batch

        def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            for batch in arrow:
                if not batch.num_rows:
                    continue
                for b in batches(batch, n_features, size):
                    out = forward(w, b)["out"][1:].transpose(1, 0, 2)
                    score = sigmoid(out @ w["output"] + w["offset"])
                    there = np.arange(out.shape[1]) < b.lengths[:, None]
                    row = pa.array(np.repeat(b.rows, b.lengths))
                    latent = pa.FixedSizeListArray.from_arrays(pa.array(out[there].ravel()), out.shape[2]).cast(pa.list_(pa.float64()))
                    columns = [batch.column(c).take(row) for c in others]
                    columns += [pa.array(b.steps[there], pa.int32()), *(pa.array(v[there]) for v in (b.label, b.weight)), pa.array(score[there]), latent]
                    yield pa.RecordBatch.from_arrays(columns, [*others, "step", "label", "weight", "score", "latent"])

        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*others).schema)
        return table.mapInArrow(run, f"{kept}, step int, label double, weight double, score double, latent array<double>")


def fit_recurrent(
    table: DataFrame, n_features: int, config: RecurrentConfig = RecurrentConfig(), schedule: Schedule = Schedule(), path: str | None = None, learn: Column | None = None
) -> RecurrentModel:
    """Fit on the train sequences of a staged ``sequences`` table, stopped by the valid ones. ``learn`` restricts the train
    sequences; without it all of them are used."""
    spark = table.sparkSession
    begin = initial(n_features, config)
    size = 4 + sum(v.size for v in begin.values())
    used = F.col("split") == "valid"
    used = used | ((F.col("split") == "train") if learn is None else (F.col("split") == "train") & learn)
    rows = table.filter(used).select("split", "mark", "steps", "x", "label", "weight")

    def evaluate(weights: Arrays, epoch: int) -> tuple[float, float, Arrays]:
        shared = spark.sparkContext.broadcast(weights)  # bounded by the shape of the model

        def of_batch(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(size)
            for b in batches(batch, n_features, config.batch):
                sums, g = loss_and_gradient(shared.value, b, epoch, config)
                total += np.concatenate([sums, np.frombuffer(packed(g))])
            return total

        total = summed(rows, of_batch, size)
        shared.unpersist()
        loss, weight, valid_loss, valid_weight = total[:4]
        g = unpacked(total[4:].tobytes(), weights)
        weight = max(weight, 1e-12)
        return loss / weight, valid_loss / valid_weight if valid_weight else float("nan"), {k: v / weight for k, v in g.items()}

    return RecurrentModel(config, n_features, train(spark, begin, evaluate, schedule, path))


def staged_sequences(rows: DataFrame, key: str, step: str, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``sequences`` as a stage table: every epoch scans it."""
    return stage(sequences(rows, key, step, features, keep), "sequences")
