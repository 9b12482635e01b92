"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# A key is hot when it holds more than this share of all rows, so there are fewer than 2,000 hot keys,
# however large the data: that is what bounds the broadcast below.
HOT_SHARE = 1 / 2000
# Keys below this many rows are never worth splitting.
HOT_FLOOR = 1_000_000

# Parts of the rows with a NULL key.
NULL_PARTS = 2000


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only after counting that the table has at most ``max_rows`` rows.

    Meant for lookup tables, where the count is one cheap job. A larger table gets no hint.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def hot_keys(
    df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, floor: int = HOT_FLOOR
) -> DataFrame:
    """``(keys…, n_salts)`` of the hot keys: fewer than ``1 / share`` rows."""
    # NULL keys match nothing. Saying so here gives all uses of the counts the same filters, so that
    # they share one shuffle.
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    limit = counts.agg(F.greatest(F.sum("_rows") * F.lit(share), F.lit(float(floor)))).scalar()
    return counts.filter(F.col("_rows") > limit).select(
        *keys, F.ceil(F.col("_rows") / limit).cast("int").alias("n_salts")
    )


def skew_join(
    facts: DataFrame,
    dims: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    condition: Column | None = None,
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
    distinct: bool = False,
) -> DataFrame:
    """Equi-join ``facts`` to ``dims`` on ``keys``, splitting the hot keys of ``facts``.

    Each fact row of a hot key goes to one of ``n_salts`` parts, chosen by a hash of its ``spread``
    columns, and the matching ``dims`` rows are copied to all parts. Every other row has a single part.
    ``how`` is ``inner``, ``left`` or ``left_semi``: each fact row is in one part only, so the result is
    that of the plain join. The part is a hash, never a random number: a task that is run again after an
    executor loss sends its rows to the same place.

    ``facts`` is read twice, once to count the keys. With ``distinct`` copies of fact rows are removed on the way: equal
    rows have equal keys and parts, so the join's own shuffle brings them together.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(facts, keys, share, floor))
    n_salts = F.coalesce("n_salts", F.lit(1))
    # A NULL key matches nothing, but a left join keeps its rows: they are spread too.
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    parts = F.when(null_key, F.lit(NULL_PARTS)).otherwise(n_salts)
    left = facts.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), parts).cast("int"))
    right = dims.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), n_salts - 1))
    )
    left, right = left.drop("n_salts"), right.drop("n_salts")
    if distinct:
        left = left.repartition(*keys, "_salt").dropDuplicates()
    return _plain_join(left, right, [*keys, "_salt"], how, condition).drop("_salt")


def _plain_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, condition: Column | None
) -> DataFrame:
    if condition is None:
        return left.join(right, list(keys), how)
    on = condition
    for name in keys:
        on = on & (left[name] == right[name])
    joined = left.join(right, on, how)
    for name in keys:
        joined = joined.drop(right[name])
    return joined
