"""Entity × time grids and the missing / zero / value distinction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def dense_grid(entities: DataFrame, n_steps: int, name: str) -> DataFrame:
    """One row per entity and step ``0 … n_steps - 1``, made in place without a shuffle."""
    return entities.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))))


def _life_end(n_days: int) -> Column:
    return F.least(F.coalesce("cancel_day", F.lit(n_days - 1)), F.lit(n_days - 1))


def zero_fill_life(days: DataFrame, spans: DataFrame, features: Sequence[str], n_days: int) -> DataFrame:
    """Usage days plus a zero row for every day of life without usage.

    Life is ``[create_day, cancel_day]`` inside the horizon ``0 … n_days - 1``. Days outside life stay missing unless
    there is usage on them.
    """
    filled = dense_days(days, spans, features, n_days)
    return filled.filter(F.col(features[0]).isNotNull()).select("seat_id", "day", *features)


def dense_days(days: DataFrame, spans: DataFrame, features: Sequence[str], n_days: int) -> DataFrame:
    """All days of every seat, with its span: usage, 0 on days of life without, NULL on others.

    What is shuffled is a row for each day with usage and one for each seat. The gaps are filled after that, as ``day_runs``
    that are spread last. Seats without a span keep their days with usage only.
    """
    runs = day_runs(days, spans, features, n_days)
    return runs.select("seat_id", F.explode(F.sequence("first", "last")).alias("day"), "create_day", "cancel_day", *features)


def day_runs(days: DataFrame, spans: DataFrame, features: Sequence[str], n_days: int) -> DataFrame:
    """``dense_days`` as runs of equal days, ``(seat_id, first, last, create_day, cancel_day, features…)``.

    A day with usage is a run of its own; the days up to the next one are cut at the ends of life, so all that differs by day
    is settled here. The days come of few rows, so the number of parts is fixed: sizes before the spread would merge them.
    """
    span = ["create_day", "cancel_day"]
    # A seat's span stands on day -1, before all usage.
    marks = spans.select("seat_id", *span, F.lit(-1).alias("day"), F.lit(True).alias("_span"))
    used = days.select("seat_id", "day", *features).filter(F.col("day").between(0, n_days - 1))
    n_parts = int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = used.unionByName(marks, allowMissingColumns=True).repartition(n_parts, "seat_id")
    rows = rows.groupBy("seat_id", "day").agg(
        *[F.max(c).alias(c) for c in span], F.max("_span").alias("_span"), *[F.sum(f).alias(f) for f in features]
    )
    by_day = Window.partitionBy("seat_id").orderBy("day")
    whole = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.withColumns(
        {c: F.max(c).over(whole) for c in [*span, "_span"]}
        | {"_next": F.coalesce(F.lead("day").over(by_day), F.lit(n_days))}
    )
    # The gap after a row; a seat without a creation day has no life.
    start, end = F.coalesce("create_day", F.lit(n_days)), _life_end(n_days)
    gap, gap_end = F.col("day") + 1, F.when(F.col("_span"), F.col("_next") - 1).otherwise(F.col("day"))
    zero = F.when(F.col("day").between(start, end), F.lit(0)).cast("bigint")

    def run(first: Column, last: Column, own: bool, fill: Column) -> Column:
        return F.struct(first.alias("first"), last.alias("last"), F.lit(own).alias("_own"), fill.cast("bigint").alias("_fill"))

    pieces = F.array(
        run(F.col("day"), F.col("day"), True, zero),
        run(gap, F.least(gap_end, start - 1), False, F.lit(None)),
        run(F.greatest(gap, start), F.least(gap_end, end), False, F.lit(0)),
        run(F.greatest(gap, start, end + 1), gap_end, False, F.lit(None)),
    )
    cut = placed.select("seat_id", *span, *features, F.inline(pieces)).filter((F.col("first") >= 0) & (F.col("first") <= F.col("last")))
    return cut.select("seat_id", "first", "last", *span, *[F.coalesce(F.when(F.col("_own"), F.col(f)), "_fill").alias(f) for f in features])


def mask_by_label(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Features → NULL where the label says outside life."""
    alive = F.col(label) != -1
    return df.withColumns({f: F.when(alive, F.col(f)) for f in features})
