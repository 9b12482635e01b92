"""Exact running totals over a globally ordered table, without one task seeing all of it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F


def value_buckets(df: DataFrame, column: str, n_buckets: int, counted: Column | None = None) -> DataFrame:
    """Add ``_bucket``, growing with ``column``, with about equally many rows in each bucket.

    The cut points are approximate quantiles of the ``counted`` rows: they decide only how even the
    buckets are.
    """
    shares = [i / n_buckets for i in range(1, n_buckets)]
    values = F.col(column) if counted is None else F.when(counted, F.col(column))
    cuts = df.agg(F.percentile_approx(values, shares, 10 * n_buckets)).scalar()
    below = F.size(F.filter("_cuts", lambda cut: cut < F.col(column)))
    return df.withColumn("_cuts", cuts).withColumn("_bucket", below).drop("_cuts")


def running_totals(
    df: DataFrame, order: Column, totals: Mapping[str, str], ascending: bool, bucket: str = "_bucket"
) -> DataFrame:
    """Add inclusive running totals ``{new name: summed column}`` in the given order.

    ``bucket`` must be monotone in the order. Bucket totals are summed first; the one-task window runs
    over them only (one row per bucket), and the rows themselves are sorted bucket by bucket.
    """
    direction = F.asc if ascending else F.desc
    sums = df.groupBy(bucket).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
    before = Window.orderBy(direction(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        bucket,
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals],
    )
    inside = (
        Window.partitionBy(bucket).orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = df.join(F.broadcast(offsets), bucket)
    return joined.withColumns(
        {n: F.sum(c).over(inside) + F.col(f"_before_{n}") for n, c in totals.items()}
    ).drop(*[f"_before_{n}" for n in totals])
