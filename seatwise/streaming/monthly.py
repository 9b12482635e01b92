"""Incremental form of the monthly job: each run takes in the months that have arrived since the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from seatwise.config import ChurnConfig
from seatwise.operators.assign import assigned_usage, prepare_usage
from seatwise.workspace import new_path

USAGE_SCHEMA = "member_id string, event_time timestamp_ntz, product_name string, session_time bigint"


EVENT_SCHEMA = USAGE_SCHEMA + ", event_date date, month string, batch bigint"


def ingest_months(
    spark: SparkSession,
    base: str,
    taxonomy: DataFrame,
    assignments: DataFrame,
    cfg: ChurnConfig,
    out: str,
    checkpoint: str | None = None,
    seen: str | None = None,
) -> StreamingQuery:
    """Assign the usage of all new month directories under ``base`` and add it to the table ``out``.

    Each run's files form one batch, written to its own directory: a batch that is run again after a
    failure replaces its own rows and no others. Events that an earlier batch has taken in are left out, so the
    sum of all runs is what one run over all files gives. ``seen`` keeps the distinct events by batch and month; a
    batch reads its own months of it.
    """
    seen = seen or f"{out.rstrip('/')}-events"
    spark.createDataFrame([], EVENT_SCHEMA).write.mode("append").partitionBy("batch", "month").parquet(seen)

    def assign(batch: DataFrame, batch_id: int) -> None:
        events = prepare_usage(batch, taxonomy, cfg).distinct().withColumn("month", F.date_format("event_time", "yyyy-MM"))
        own = f"{seen}/batch={batch_id}"
        # One row for each month of the batch.
        months = [r["month"] for r in events.select("month").distinct().collect()]
        earlier = spark.read.schema(EVENT_SCHEMA).parquet(seen).filter((F.col("batch") < batch_id) & F.col("month").isin(months))
        # NULL equals NULL inside a struct.
        columns = events.columns
        key = F.struct(*columns)
        new = events.withColumn("_event", key).join(earlier.select(key.alias("_event")), "_event", "left_anti").select(columns)
        new.write.mode("overwrite").partitionBy("month").parquet(own)
        taken = spark.read.schema(EVENT_SCHEMA).parquet(own).drop("month", "batch")
        assigned_usage(taken, assignments, cfg).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        spark.readStream.schema(USAGE_SCHEMA).parquet(f"{base}/*")
        .writeStream.foreachBatch(assign)
        .option("checkpointLocation", checkpoint or new_path(spark, "ingest"))
        .trigger(availableNow=True)
        .start()
    )
