"""Checks on intermediate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """One row: number of rows and of distinct values of each column.

    Exact counts first reduce the rows to their distinct combinations, so the per-column counting, which
    copies its input once per column, starts from far fewer rows.
    """
    if approximate:
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns],
        )
    combinations = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))
    return combinations.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
        *[F.count_distinct(c).alias(f"n_{c}") for c in columns],
    )


def check_functional_dependency(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per column: number of keys that have more than one value of it.

    Rows are reduced to distinct combinations first, so a heavy key is small before it is gathered.
    """
    spans = df.select(key, *columns).distinct().groupBy(key).agg(
        *[F.min(c).alias(f"_min_{c}") for c in columns], *[F.max(c).alias(f"_max_{c}") for c in columns]
    )
    counts = spans.agg(
        *[F.count_if(F.col(f"_min_{c}") != F.col(f"_max_{c}")).alias(c) for c in columns]
    )
    return counts.unpivot([], list(columns), "column", "violations")


def check_mask_consistency(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """One row: cells, and those that have a feature although their label is outside life (must be 0)."""
    present = F.col(features[0]).isNotNull()
    for f in features[1:]:
        present = present | F.col(f).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(present & (F.col(label) == -1)).alias("n_masked_with_features"),
    )


def check_event_after_create(df: DataFrame) -> DataFrame:
    """One row: events dated before the creation of their seat (must be 0)."""
    return df.agg(F.count_if(F.col("event_date") < F.col("create_date")).alias("n_before_create"))


def label_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
