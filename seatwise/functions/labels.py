"""Churn label of one time step, and of a whole time line."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed label values.
OUTSIDE = -1
ALIVE = 0
CHURN = 1


def label_at(step: Column, created: Column, cancelled: Column, n_steps: int) -> Column:
    """Label of ``step``: outside life, alive, or the step of cancellation.

    No cancellation, or one at or past ``n_steps``, is censored: alive to the end. A cancellation before
    step 0 leaves every step outside; one between step 0 and creation leaves only its own step.
    """
    censored = cancelled.isNull() | (cancelled >= n_steps)
    churns = ~censored & (step == cancelled)
    alive = (step >= created) & (censored | (step < cancelled))
    return F.when(churns, F.lit(CHURN)).when(alive, F.lit(ALIVE)).otherwise(F.lit(OUTSIDE))


def label_array(created: Column, cancelled: Column, n_steps: int) -> Column:
    """``label_at`` for steps ``0 … n_steps - 1``.

    Put together from runs of equal labels, which stays in generated code; a function applied to each
    step would not.
    """

    def run(label: int, length: Column) -> Column:
        return F.array_repeat(F.lit(label), length)

    n = F.lit(n_steps)
    censored = cancelled.isNull() | (cancelled >= n_steps)
    end = F.when(censored, n).otherwise(cancelled)
    start = F.greatest(F.least(created, n), F.lit(0))
    churn = F.when(censored, F.lit(0)).otherwise(F.lit(1))
    line = F.concat(
        run(OUTSIDE, F.least(start, end)),
        run(ALIVE, F.greatest(end - start, F.lit(0))),
        run(CHURN, churn),
        run(OUTSIDE, n - end - churn),
    )
    return F.when(cancelled < 0, run(OUTSIDE, n)).otherwise(line)


def label_weight(label: Column, positive_weight: float) -> Column:
    """Training weight: outside steps count nothing, churn steps ``positive_weight``."""
    return (
        F.when(label == CHURN, F.lit(float(positive_weight)))
        .when(label == ALIVE, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
