"""Missing values and feature arrays.

NULL is the only mask inside the library: Spark aggregates skip it, whereas NaN would spread.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def encode_missing(value: Column, missing: float = -1) -> Column:
    """NULL or NaN → the missing value that models take."""
    return F.when(value.isNull() | F.isnan(value), F.lit(missing)).otherwise(value)


def decode_missing(value: Column, missing: float = -1) -> Column:
    """The missing value → NULL."""
    return F.nullif(value, F.lit(missing))


def total(columns: list[str]) -> Column:
    """Sum of several columns of a row, NULL if any is."""
    result = F.col(columns[0])
    for name in columns[1:]:
        result = result + F.col(name)
    return result


def total_slice(values: Column, first: int, length: int) -> Column:
    """Sum of ``length`` array elements from position ``first`` (1-based)."""
    return F.aggregate(F.slice(values, first, length), F.lit(0.0), lambda acc, v: acc + v)


def squeeze_array(values: Column, n_categories: int) -> Column:
    """(total time, total count) of a feature array of times followed by counts."""
    return F.array(
        total_slice(values, 1, n_categories), total_slice(values, n_categories + 1, n_categories)
    )
