"""Churn-shaped inputs derived from a star schema and an event log.

Customers act as seats, nation and segment as contracts, order lines as usage sessions and part names as
raw product aliases. Each seat has two sessions, held by different members.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seatwise.config import ChurnConfig
from seatwise.sources.tables import scan_parquet

DAY_ONE = date(1995, 5, 1)

STAR = ChurnConfig(
    create_from=DAY_ONE,
    create_to=date(1996, 5, 29),
    event_from=DAY_ONE,
    event_to=date(1996, 4, 29),
    # "Rod" is in the wrong case on purpose: it matches nothing.
    interest=("anvil", "bolt", "gear", "gizmo", "plate", "ring", "Rod", "widget"),
    categories=("anvil", "bolt", "gear", "gizmo", "plate", "ring", "widget"),
)

EVENTS_START = date(2024, 1, 1)

EVENTS = ChurnConfig(
    create_from=EVENTS_START,
    create_to=date(2024, 1, 30),
    event_from=EVENTS_START,
    event_to=date(2024, 1, 30),
    interest=("click", "error", "purchase", "signup", "view"),
    categories=("click", "error", "purchase", "signup", "view"),
    horizon_days=30,
    period_days=5,
    summed_days=4,
    n_periods=7,
    day_zero=EVENTS_START,
)


# Columns used here; with a schema given, no footer is read to plan a scan.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double",
    "part": "p_partkey bigint, p_name string",
    "events": "ts timestamp_ntz, user_id bigint, event_type string, value double",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet", SCHEMAS.get(name))


def _day(offset: Column) -> Column:
    return F.date_add(F.lit(DAY_ONE), offset.cast("int")).cast("timestamp_ntz")


def star_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    n_customers = customer.agg(F.count(F.lit(1))).scalar()
    key, k = F.col("c_custkey"), F.col("k")
    start = key * 37 % 200
    first = k == 0
    member = ((key + k) % F.col("n")).cast("string")
    contract_end = 250 + (F.col("c_nationkey") * 97 + F.length("c_mktsegment") * 41) % 500
    rows = customer.withColumn("n", n_customers).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(
        F.when((key % 50 == 0) & first, F.lit(STAR.unassigned_member)).otherwise(member).alias("member_id"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), "c_mktsegment").alias("contract_id"),
        key.cast("string").alias("seat_id"),
        _day(start + 90 * k).alias("start_time"),
        F.when(first, _day(start + 89)).otherwise(_day(start + 90 + key * 17 % 400)).alias("end_time"),
        _day(start).alias("seat_created_date"),
        _day(start + 30 + key * 53 % 600).alias("seat_cancelled_date"),
        _day(F.col("c_nationkey") * 11 % 60).alias("contract_created_date"),
        _day(contract_end).alias("contract_cancelled_date"),
    )


def star_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).join(
        parts, lines["l_partkey"] == parts["p_partkey"]
    )
    return joined.select(
        F.col("o_custkey").cast("string").alias("member_id"),
        F.col("o_orderdate").alias("event_time"),
        F.col("p_name").alias("product_name"),
        F.col("l_quantity").cast("bigint").alias("session_time"),
    )


def star_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    category = F.expr("substring(p_name, position(' ' in p_name) + 1)")
    return table(spark, sf_dir, "part").select(name.alias("alias"), category.alias("category")).distinct()


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats of the event log: one per user, with day numbers for creation and cancellation."""
    user = F.col("user_id")
    created = (user * 7 % 10).cast("int")
    return table(spark, sf_dir, "events").select(
        user.alias("member_id"),
        F.concat(F.lit("S"), user.cast("string")).alias("seat_id"),
        (user % 12).alias("contract_id"),
        created.alias("create_day"),
        (created + 5 + (user * 11 % 40)).cast("int").alias("cancel_day"),
    ).distinct()


def event_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("member_id"),
        F.col("ts").alias("event_time"),
        F.col("event_type").alias("product_name"),
        F.round(F.col("value") * 100).cast("bigint").alias("session_time"),
        F.to_date("ts").alias("event_date"),
    )


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans as sessions: from midnight of the creation day to the last instant of the cancellation day."""
    start = F.date_add(F.lit(EVENTS_START), F.col("create_day"))
    end = F.date_add(F.lit(EVENTS_START), F.col("cancel_day"))
    return event_spans(spark, sf_dir).select(
        "member_id",
        "seat_id",
        "contract_id",
        start.alias("create_date"),
        start.cast("timestamp_ntz").alias("start_time"),
        (F.date_add(end, 1).cast("timestamp_ntz") - F.expr("interval 1 microsecond")).alias("end_time"),
        end.alias("seat_cancelled_date"),
        end.alias("contract_cancelled_date"),
    )
