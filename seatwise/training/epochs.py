"""Training by epochs: losses of both splits in one scan, patience, the best epoch restored, runs that go on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from seatwise.training.sums import Arrays, packed, unpacked
from seatwise.workspace import new_path

STATE = "epoch int, train_loss double, valid_loss double, state binary"


@dataclass(frozen=True)
class Schedule:
    """At most ``epochs`` steps of size ``rate``; the run ends after ``patience`` epochs without a lower valid loss."""

    epochs: int = 40
    rate: float = 0.02
    patience: int = 10


@dataclass(frozen=True)
class Fitted:
    """Weights of the epoch with the least valid loss, and ``(epoch, train_loss, valid_loss)`` of all epochs."""

    weights: Arrays
    best_epoch: int
    history: list[tuple[int, float, float]]

    def table(self, spark: SparkSession, model: str) -> DataFrame:
        """``(model, iteration, train_loss, valid_loss)``."""
        return spark.createDataFrame([(model, *row) for row in self.history], "model string, iteration int, train_loss double, valid_loss double")


class States:
    """The states of a run, one row for each epoch, in the shared folder. What is not yet whole is not read."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self) -> list[str]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        done = [s.getPath() for s in files.listStatus(root)]
        marker = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return [p.toString() for p in done if files.exists(marker(p, "_SUCCESS"))]

    def write(self, epoch: int, train_loss: float, valid_loss: float, state: Arrays) -> None:
        row = self.spark.createDataFrame([(epoch, train_loss, valid_loss, packed(state))], STATE)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{epoch:06d}")

    def history(self) -> list[tuple[int, float, float]]:
        folders = self._folders()
        if not folders:
            return []
        rows = self.spark.read.schema(STATE).parquet(*folders).select("epoch", "train_loss", "valid_loss")
        return sorted(tuple(r) for r in rows.collect())  # a row for each epoch

    def state(self, epoch: int, like: Arrays) -> Arrays:
        row = self.spark.read.schema(STATE).parquet(f"{self.path}/{epoch:06d}").select("state").first()
        return unpacked(row["state"], like)


def moments(weights: Arrays) -> Arrays:
    """Weights with the moments of their gradients."""
    return {**weights, **{f"{kind}.{k}": np.zeros_like(v) for kind in "mv" for k, v in weights.items()}}


def stepped(state: Arrays, gradient: Arrays, turn: int, rate: float) -> Arrays:
    """The state after the ``turn``-th step of adaptive moments."""
    result = dict(state)
    for k, g in gradient.items():
        m, v = 0.9 * state[f"m.{k}"] + 0.1 * g, 0.999 * state[f"v.{k}"] + 0.001 * g * g
        result[f"m.{k}"], result[f"v.{k}"] = m, v
        result[k] = state[k] - rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return result


def part(state: Arrays, kind: str = "") -> Arrays:
    """The weights in a state, or with ``kind`` the arrays of that kind."""
    if not kind:
        return {k: v for k, v in state.items() if "." not in k}
    return {k[len(kind) + 1 :]: v for k, v in state.items() if k.startswith(f"{kind}.")}


def best_epoch(history: list[tuple[int, float, float]]) -> int:
    """The first epoch with the least valid loss; without valid rows (a loss of NaN) the last epoch."""
    known = [row for row in history if row[2] == row[2]]
    return min(known, key=lambda row: (row[2], row[0]))[0] if known else history[-1][0]


def train(
    spark: SparkSession, initial: Arrays, evaluate: Callable[[Arrays, int], tuple[float, float, Arrays]], schedule: Schedule, path: str | None = None
) -> Fitted:
    """Step by step from ``initial``. ``evaluate(weights, epoch)`` gives the train loss, the valid loss and the train
    loss's gradient from one scan.

    Each epoch's state is written below ``path``, with its gradient. A run that finds states there goes on after the last of
    them, and ends as if it had never stopped.
    """
    states = States(spark, path or new_path(spark, "epochs"))
    start = moments(initial)
    whole = {**start, **{f"g.{k}": v for k, v in initial.items()}}
    state, gradient, history = start, {}, states.history()
    if history:
        found = states.state(history[-1][0], whole)
        state, gradient = {k: found[k] for k in start}, part(found, "g")
    while len(history) < schedule.epochs and not (history and len(history) - 1 - best_epoch(history) >= schedule.patience):
        epoch = len(history)
        if epoch:
            state = stepped(state, gradient, epoch, schedule.rate)
        train_loss, valid_loss, gradient = evaluate(part(state), epoch)
        train_loss, valid_loss = float(train_loss), float(valid_loss)
        states.write(epoch, train_loss, valid_loss, {**state, **{f"g.{k}": v for k, v in gradient.items()}})
        history.append((epoch, train_loss, valid_loss))
    best = best_epoch(history)
    return Fitted(part(states.state(best, whole)), best, history)
