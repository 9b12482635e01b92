"""Runs that arrive one after another give what one run over all files gives."""

from collections import Counter
from dataclasses import replace

from seatwise.fixtures import STAR
from seatwise.operators.assign import assigned_usage, prepare_usage
from seatwise.streaming.monthly import USAGE_SCHEMA, ingest_months

DAY = "timestamp_ntz'1995-06-{:02d} 10:00:00'"


def rows(spark, days, times=1):
    parts = [f"select 'm{d % 3}' as member_id, {DAY.format(d)} as event_time, 'a {d % 2}' as product_name, {d}L as session_time" for d in days]
    df = spark.sql(" union all ".join(parts * times))
    return df.select([c.split()[0] for c in USAGE_SCHEMA.split(", ")]).coalesce(1)


def test_copies_in_later_runs(spark, tmp_path):
    base, out, checkpoint = (str(tmp_path / n) for n in ("base", "out", "checkpoint"))
    taxonomy = spark.createDataFrame([("a 0", "anvil"), ("a 1", "anvil")], "alias string, category string")
    start, end = DAY.format(1).replace("10:00", "00:00"), DAY.format(29)
    sessions = spark.range(3).selectExpr(
        "concat('m', id) as member_id", "concat('c', id) as contract_id", "concat('s', id) as seat_id", f"{start} as start_time", f"{end} as end_time",
        "date'1995-06-01' as create_date", "date'1996-01-01' as seat_cancelled_date", "date'1996-01-01' as contract_cancelled_date",
    )
    cfg = replace(STAR, interest=("anvil",))
    for days in ([1, 2, 3, 4], [3, 4, 5, 6], [5]):
        rows(spark, days, 2).write.mode("append").parquet(f"{base}/month=1995-06")
        ingest_months(spark, base, taxonomy, sessions, cfg, out, checkpoint).awaitTermination()
    whole = assigned_usage(prepare_usage(spark.read.schema(USAGE_SCHEMA).parquet(f"{base}/*"), taxonomy, cfg), sessions, cfg)
    got = spark.read.parquet(out).select(whole.columns)
    assert got.count() == 6
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, whole.collect()))
