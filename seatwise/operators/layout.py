"""Events kept in the form that the interval join needs, so that a run never shuffles the events of earlier months.

A layout is a folder of batches. Each batch is written once, as Parquet files by calendar month, bucketed by member and
slot. A slot is a month and, for members that hold much of it, a part of the month's events; sessions are copied to the slots
they touch and shuffled into the same buckets. So the events are joined where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from seatwise.config import ChurnConfig
from seatwise.operators.assign import in_session
from seatwise.operators.skew import HOT_FLOOR, HOT_SHARE, broadcast_if_small, hot_keys
from seatwise.workspace import delete, stage

EVENT_SCHEMA = "member_id string, event_time timestamp_ntz, product_name string, session_time bigint, event_date date"
# Parts that a member's month can have; ``hot_keys`` gives at most 1 / HOT_SHARE.
SLOTS = 4096


@dataclass(frozen=True)
class EventLayout:
    """A layout at ``path``. ``buckets`` and ``schema`` must stay the same for all batches.

    ``schema`` is that of ``prepare_usage``. A bucket is one task of the join, so take as many as make a month's files fit
    into memory when one run reads all of them.
    """

    path: str
    buckets: int
    schema: str = EVENT_SCHEMA

    def folder(self, batch: int) -> str:
        return f"{self.path}/events/batch={batch}"

    def split_folder(self, batch: int) -> str:
        return f"{self.path}/splits/batch={batch}"


def month_number(day: Column) -> Column:
    """Calendar months since year 0."""
    return F.year(day) * 12 + F.month(day) - 1


def laid_out(spark: SparkSession, layout: EventLayout) -> DataFrame:
    """All events with ``slot``, ``batch`` and ``month``, as a bucketed scan pruned by the latter two."""
    name = f"events_{uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromDDL(layout.schema))
    spark.sql(
        f"create table {name} ({columns}, slot int, batch bigint, month int) using parquet partitioned by (batch, month) "
        f"clustered by (member_id, slot) into {layout.buckets} buckets location '{layout.path}/events'"
    )
    spark.sql(f"alter table {name} recover partitions")
    return spark.table(name)


def splits(spark: SparkSession, layout: EventLayout) -> DataFrame:
    """``(member_id, month, n_salts)`` of the members whose months lie in several slots, the most of all batches."""
    kind = StructType.fromDDL(layout.schema)["member_id"].dataType.simpleString()
    rows = spark.read.schema(f"member_id {kind}, month int, n_salts int, batch bigint").parquet(f"{layout.path}/splits")
    return rows.groupBy("member_id", "month").agg(F.max("n_salts").alias("n_salts"))


def add_events(layout: EventLayout, events: DataFrame, batch: int, share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> DataFrame:
    """Add the events that no earlier batch holds, and return them.

    ``events`` come from ``prepare_usage``; copies among them are removed in the shuffle that deals them to buckets, copies of
    earlier events by a join with those of the same months. Events without a member or a time belong to nobody and are left
    out. A batch that is run again replaces itself. Batches are to be added in the order of their numbers. A batch may be empty.
    """
    spark = events.sparkSession
    names = [f.name for f in StructType.fromDDL(layout.schema)]
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(layout.schema)]
    rows = events.select(typed).filter(F.col("member_id").isNotNull() & F.col("event_time").isNotNull())
    rows = rows.withColumn("month", month_number(F.col("event_date")))

    hot = stage(hot_keys(rows, ["member_id", "month"], share, floor), "splits", layout.split_folder(batch))
    salt = F.pmod(F.xxhash64(*names), F.least(F.coalesce("n_salts", F.lit(1)), F.lit(SLOTS)))
    dealt = rows.join(F.broadcast(hot), ["member_id", "month"], "left")
    dealt = dealt.select(*names, (F.col("month") * SLOTS + salt).cast("int").alias("slot"), "month")
    dealt = dealt.repartition(layout.buckets, "member_id", "slot").dropDuplicates()

    if batch_numbers(spark, f"{layout.path}/events", batch):
        # One row for each month of the batch.
        months = [r["month"] for r in rows.select("month").distinct().collect()]
        earlier = laid_out(spark, layout).filter((F.col("batch") < batch) & F.col("month").isin(months))
        if not earlier.isEmpty():
            # NULL equals NULL inside a struct. Copies may lie in other slots, if the member had fewer events then.
            key = F.struct(*names)
            # By their size in files, events look small enough to send whole to the driver; in memory they are many times that.
            known = earlier.select(key.alias("_event")).hint("merge")
            dealt = dealt.withColumn("_event", key).join(known, "_event", "left_anti").drop("_event")
            dealt = dealt.repartition(layout.buckets, "member_id", "slot")

    name = f"batch_{uuid4().hex}"
    delete(spark, layout.folder(batch))
    writer = dealt.write.partitionBy("month").bucketBy(layout.buckets, "member_id", "slot").option("compression", "zstd")
    writer.option("path", layout.folder(batch)).saveAsTable(name)
    # The files stay, and so does the bucket number in their names.
    spark.sql(f"drop table {name}")
    return laid_out(spark, layout).filter(F.col("batch") == batch).select(names)


def batch_numbers(spark: SparkSession, folder: str, below: int) -> list[int]:
    """The batches under ``folder`` before ``below``, by their folder names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted(n for n in (int(f.removeprefix("batch=")) for f in found if f.startswith("batch=")) if n < below)


def join_laid_out(
    layout: EventLayout, assignments: DataFrame, cfg: ChurnConfig, keep: Column | None = None, months: Sequence[int] | None = None
) -> DataFrame:
    """Every event with every session of its member that contains it; the events are not shuffled.

    ``keep`` (on ``batch``) and ``months`` prune the scan. Columns are those of ``interval_join``; ``assignments`` may bring more.
    """
    spark = assignments.sparkSession
    names = [f.name for f in StructType.fromDDL(layout.schema)]
    first, last = F.lit(cfg.event_from), F.lit(cfg.event_to)
    events = laid_out(spark, layout).filter(F.col("event_date").between(first, last))
    events = events.filter((F.col("month") >= month_number(first)) & (F.col("month") <= month_number(last)))
    if keep is not None:
        events = events.filter(keep)
    touched = touched_months(assignments, cfg)
    if months is not None:
        events = events.filter(F.col("month").isin(list(months)))
        touched = touched.filter(F.col("_month").isin(list(months)))
    hot = broadcast_if_small(splits(spark, layout).select("member_id", F.col("month").alias("_month"), "n_salts"))
    most = F.least(F.coalesce("n_salts", F.lit(1)), F.lit(SLOTS))
    sessions = touched.join(hot, ["member_id", "_month"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), most - 1)))
    sessions = sessions.withColumn("slot", (F.col("_month") * SLOTS + F.col("_salt")).cast("int")).select(*assignments.columns, "slot")
    sessions = sessions.repartition(layout.buckets, "member_id", "slot")
    events = events.select(*names, "slot")
    on = (events["member_id"] == sessions["member_id"]) & (events["slot"] == sessions["slot"]) & in_session(F.col)
    # Not by broadcast of the events, however small their files are: they would pass through the driver.
    return events.join(sessions.hint("merge"), on).drop(sessions["member_id"]).drop("slot")


def touched_months(assignments: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Each session with each ``_month`` of the event window that it can have events in."""
    start = F.greatest(F.to_date("start_time"), "create_date", F.lit(cfg.event_from))
    end = F.least(F.to_date("end_time"), F.lit(cfg.event_to))
    whole = F.col("member_id").isNotNull() & F.col("create_date").isNotNull() & (F.col("start_time") <= F.col("end_time"))
    kept = assignments.filter(whole & (start <= end))
    return kept.withColumn("_month", F.explode(F.sequence(month_number(start), month_number(end))))


def assigned_from_layout(layout: EventLayout, assignments: DataFrame, cfg: ChurnConfig, months: Sequence[int] | None = None) -> DataFrame:
    """``assigned_usage`` of all events of a layout, or of some months of it (``month_number``)."""
    df = join_laid_out(layout, assignments, cfg, months=months)
    if cfg.dedup_per_seat:
        df = df.dropDuplicates([*[f.name for f in StructType.fromDDL(layout.schema)], "seat_id"])
    return df.drop("event_time", "start_time", "end_time")
