"""Figures taken along by a job that runs anyway, and distinct counts kept by month and merged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from seatwise.workspace import stage

# 2 ** 14 registers: a relative standard error of about 0.8 %, the merged sketch included; up to some thousand values
# the count is all but exact.
SKETCH_SIZE = 14


def mask_figures(features: Sequence[str], label: str = "label") -> dict[str, Column]:
    """``check_mask_consistency`` as figures."""
    present = F.lit(False)
    for f in features:
        present = present | F.col(f).isNotNull()
    return {"n_cells": F.count(F.lit(1)), "n_masked_with_features": F.count_if(present & (F.col(label) == -1))}


def create_figures() -> dict[str, Column]:
    """``check_event_after_create`` as figures."""
    return {"n_before_create": F.count_if(F.col("event_date") < F.col("create_date"))}


def label_figures(label: str = "label", values: Sequence[int] = (-1, 0, 1)) -> dict[str, Column]:
    """``label_histogram`` of the labels that exist, and what is none of them, NULL included."""
    counts = {f"n_label_{'m1' if v == -1 else v}": F.count_if(F.col(label) == v) for v in values}
    return counts | {"n_label_other": F.count_if(~F.coalesce(F.col(label).isin(list(values)), F.lit(False)))}


def distinct_figures(columns: Sequence[str]) -> dict[str, Column]:
    """``distinct_counts`` by sketches: approximate, NULL not counted."""
    return {f"n_{c}": F.approx_count_distinct(c, 0.01) for c in columns}


def observed_stage(df: DataFrame, name: str, figures: Mapping[str, Column], path: str | None = None) -> tuple[DataFrame, dict[str, object]]:
    """``stage``, and the figures over the rows that it writes, from the same job: nothing is read again.

    Figures are aggregates without DISTINCT or grouping; ``check_functional_dependency``, which groups, is not among
    them. A task that runs again after a loss counts once. An empty table has counts of 0.
    """
    watch = Observation()
    table = stage(df.observe(watch, *[c.alias(n) for n, c in figures.items()]), name, path)
    return table, watch.get


def month_sketches(df: DataFrame, columns: Sequence[str], month: Column) -> DataFrame:
    """``(month, n_rows, sketch_…)``: one small row for each month, aggregated in the tasks first."""
    return df.groupBy(F.coalesce(month.cast("string"), F.lit("none")).alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_SIZE).alias(f"sketch_{c}") for c in columns]
    )


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Keep the sketches of these months; a month that is stored already is replaced, the others stay."""
    sketches.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def merged_counts(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``n_rows`` and about how many distinct values each column has over all the months given. A value in several
    months counts once."""
    return sketches.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")), F.lit(0)).alias(f"n_{c}") for c in columns],
    )


def stored_counts(spark: SparkSession, path: str, columns: Sequence[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """``merged_counts`` of the stored months from ``first`` to ``last``; only their files are read."""
    fields = ", ".join(["n_rows bigint", *[f"sketch_{c} binary" for c in columns], "month string"])
    months = spark.read.schema(fields).parquet(path)
    for bound, inside in ((first, F.col("month") >= F.lit(first)), (last, F.col("month") <= F.lit(last))):
        months = months if bound is None else months.filter(inside)
    return merged_counts(months, columns)
