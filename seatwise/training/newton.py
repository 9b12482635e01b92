"""Weighted logistic regression by Newton steps: cross-products added up in Spark, the driver holds one small matrix."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seatwise.training.sums import summed


@dataclass(frozen=True)
class NewtonModel:
    """``history`` has (iteration, train loss, valid loss); the losses are weighted means without the penalty."""

    features: tuple[str, ...]
    coefficients: np.ndarray
    intercept: float
    history: list[tuple[int, float, float]]
    converged: bool

    def margin(self) -> Column:
        total = F.lit(float(self.intercept))
        for name, value in zip(self.features, self.coefficients, strict=True):
            total = total + F.lit(float(value)) * F.col(name)
        return total

    def scored(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the probability of churn."""
        return df.withColumn("score", 1 / (1 + F.exp(-self.margin())))


def fit_newton(rows: DataFrame, features: Sequence[str], penalty: float = 1e-6, iterations: int = 50, tolerance: float = 1e-9) -> NewtonModel:
    """Least mean weighted log loss plus ``penalty`` / 2 times the squared coefficients (not the intercept), on the rows whose
    ``split`` is train; the loss of the valid rows comes from the same scan.

    A step is halved while it does not lower the objective, so the train objective never rises. Converged where no entry of
    the gradient exceeds ``tolerance``.
    """
    names, n = tuple(features), len(features) + 1
    table = rows.filter(F.col("split").isin("train", "valid")).select(
        (F.col("split") == "train").alias("learn"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"),
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(names)],
    )
    size = 4 + n + n * n
    ridge = np.full(n, penalty)
    ridge[-1] = 0

    def evaluate(beta: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        def of_batch(batch: pa.RecordBatch) -> np.ndarray:
            x = np.column_stack([*(batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(n - 1)), np.ones(batch.num_rows)])
            label, weight = batch.column("label").to_numpy(zero_copy_only=False), batch.column("weight").to_numpy(zero_copy_only=False)
            learn = batch.column("learn").to_numpy(zero_copy_only=False)
            z = x @ beta
            loss = weight * (np.logaddexp(0, z) - label * z)
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            used = np.where(learn, weight, 0.0)
            return np.concatenate(
                [[loss[learn].sum(), weight[learn].sum(), loss[~learn].sum(), weight[~learn].sum()], x.T @ (used * (p - label)), (x.T @ (x * (used * p * (1 - p))[:, None])).ravel()]
            )

        total = summed(table, of_batch, size)
        weight = max(total[1], 1e-300)
        valid = total[2] / total[3] if total[3] else float("nan")
        return float(total[0] / weight), float(valid), total[4 : 4 + n] / weight + ridge * beta, total[4 + n :].reshape(n, n) / weight + np.diag(ridge)

    beta = np.zeros(n)
    loss, valid, slope, bend = evaluate(beta)
    history = [(0, loss, valid)]

    def objective(loss: float, beta: np.ndarray) -> float:
        return loss + 0.5 * float(ridge @ (beta * beta))

    while np.abs(slope).max() > tolerance and len(history) <= iterations:
        move = np.linalg.lstsq(bend, slope, rcond=None)[0]
        before = objective(loss, beta)
        for half in range(30):
            found = evaluate(beta - move * 0.5**half)
            if objective(found[0], beta - move * 0.5**half) <= before + 1e-15:
                break
        else:
            break  # no step lowers the objective: the precision of the sums is reached
        beta = beta - move * 0.5**half
        loss, valid, slope, bend = found
        history.append((len(history), loss, valid))
    return NewtonModel(names, beta[:-1], float(beta[-1]), history, bool(np.abs(slope).max() <= max(tolerance, 1e-7)))
