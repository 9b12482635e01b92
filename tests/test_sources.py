"""Files in and out."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seatwise import workspace
from seatwise.operators import quality, scale
from seatwise.sources import tables, taxonomy


def test_taxonomy_lines(spark, tmp_path):
    path = tmp_path / "names.txt"
    path.write_text('  First: ["a b", "A-B: c"]\n\nSecond:  ["d",  "é, f"]\nThird: ["d"]\nno list here\n')
    rows = {r.alias: r.category for r in taxonomy.load_taxonomy(spark, str(path)).collect()}
    assert rows == {"a b": "First", "A-B: c": "First", "d": "Second", "é, f": "Second"}
    out = str(tmp_path / "again")
    taxonomy.write_taxonomy(taxonomy.load_taxonomy(spark, str(path)), out)
    assert {r.alias: r.category for r in taxonomy.load_taxonomy(spark, out).collect()} == rows


def test_monthly_paths(spark, tmp_path):
    base = str(tmp_path)
    for month in ("2020-01", "2020-02", "2020-03"):
        spark.createDataFrame([(month, 1)], "m string, v int").write.parquet(f"{base}/{month}")
    df = tables.scan_monthly_paths(spark, base, ["2020-01", "2020-03"], "m string, v int")
    assert sorted(r.m for r in df.collect()) == ["2020-01", "2020-03"]


def test_files_without_rows_are_listed(spark, tmp_path):
    path = str(tmp_path / "a b%c")
    spark.range(3).coalesce(1).write.parquet(path)
    spark.range(0).coalesce(1).write.mode("append").parquet(path)
    found = tables.list_input_files(spark.read.parquet(path)).collect()
    assert sorted(r.n_rows for r in found) == [0, 3]
    assert len({r.file_path.rsplit("/", 1)[0] for r in found}) == 1


def test_overwrite_files_and_splits(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_parquet_overwrite(spark.range(10), path)
    tables.write_parquet_overwrite(spark.range(3).repartition(2), path)
    df = tables.scan_parquet(spark, path, "id bigint")
    assert df.count() == 3
    assert sum(r.n_rows for r in tables.list_input_files(df).collect()) == 3
    parts = str(tmp_path / "p")
    rows = spark.range(9).selectExpr("id", "case when id < 2 then 'test' else 'train' end as split")
    tables.write_split_sets(rows, parts, "id", 4)
    assert tables.read_split_set(spark, parts, "test").count() == 2
    assert tables.load_intermediate(spark, path, ["id"]).columns == ["id"]


def test_union_all_keeps_copies_and_matches_names(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(2, 1)], "y int, x int")
    assert [tuple(r) for r in tables.union_all(a, b, a).collect()] == [(1, 2)] * 3


def test_stage_is_a_new_table_each_time(spark):
    first, second = (workspace.stage(spark.range(5), "n") for _ in range(2))
    assert first.inputFiles() != second.inputFiles() and first.count() == 5


def test_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        workspace.shared_root(Session)
    Session.conf.get = staticmethod(lambda key, default=None: "hdfs://shared/")
    assert workspace.shared_root(Session) == "hdfs://shared"


def test_quality(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 2, "x"), ("b", 2, "x")], "k string, u int, v string")
    assert {r.column: r.violations for r in quality.check_functional_dependency(df.withColumn("u", df.u.cast("string")), "k", ["u", "v"]).collect()} == {"u": 0, "v": 1}
    row = quality.distinct_counts(df, ["k", "v"]).first()
    assert (row.n_rows, row.n_k, row.n_v) == (4, 2, 2)
    assert quality.distinct_counts(df, ["k"], approximate=True).first().n_k == 2
    cells = spark.createDataFrame([(-1, None, None), (-1, None, 3), (0, 1, None)], "label int, x int, y int")
    row = quality.check_mask_consistency(cells, ["x", "y"]).first()
    assert (row.n_cells, row.n_masked_with_features) == (3, 1)


def test_scaler(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 5.0), (0, 3.0, 5.0), (0, None, 5.0), (1, 4.0, None), (1, 8.0, None)], "month int, x double, y double"
    )
    state = scale.fit_std_scaler(df, ["x", "y"])
    rows = scale.apply_std_scaler(df, state, ["x", "y"]).collect()
    # No centring; a standard deviation of 0 leaves the cell missing.
    assert sorted(r.x for r in rows if r.month == 0 and r.x is not None) == [1.0, 3.0]
    assert sorted(r.x for r in rows if r.month == 1) == [2.0, 4.0]
    assert all(r.y is None for r in rows)
    centred = scale.standardize(df, scale.fit_standardizer(df, ["x"]), ["x"]).collect()
    assert sorted(r.x for r in centred if r.x is not None) == [-1.0, -1.0, 1.0, 1.0]


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_merged_scaler_equals_that_of_all_rows(spark, tmp_path, offset):
    """Any parts of the rows, empty ones and missing values included; values far from 0 keep their digits."""
    rng = random.Random(3)
    data = [(m, rng.randrange(5), None if rng.random() < 0.2 else offset + rng.random(), float(m), None) for m in range(3) for _ in range(40)]
    df = spark.createDataFrame(data, "month int, part int, x double, y double, z double")
    names, path = ["x", "y", "z"], str(tmp_path / "moments")
    for k in (0, 1, 2, 3, 4, 5, 2):
        scale.store_moments(df.filter(F.col("part") == k), names, path, str(k))
    merged = {r.month: r for r in scale.stored_scaler(spark, names, path).collect()}
    for m in range(3):
        x = [v for month, _, v, _, _ in data if month == m and v is not None]
        mean = math.fsum(x) / len(x)
        deviation = math.sqrt(math.fsum((v - mean) ** 2 for v in x) / len(x))
        assert merged[m].std_x == pytest.approx(deviation, rel=1e-6) and merged[m].mean_x == pytest.approx(mean)
        assert (merged[m].std_y, merged[m].mean_y, merged[m].std_z, merged[m].mean_z) == (0, m, None, None)


def test_ingest_takes_each_month_once(spark, tmp_path):
    from seatwise.fixtures import STAR
    from seatwise.streaming.monthly import USAGE_SCHEMA, ingest_months

    taxonomy_rows = spark.createDataFrame([("old bolt", "bolt")], "alias string, category string")
    sessions = spark.sql(
        "select 'm' as member_id, 'c' as contract_id, 's' as seat_id, timestamp_ntz '1995-05-01' as start_time, "
        "timestamp_ntz '1996-05-01' as end_time, date '1996-05-01' as seat_cancelled_date, "
        "date '1997-05-01' as contract_cancelled_date, date '1995-05-01' as create_date"
    )
    base, out, state = (str(tmp_path / name) for name in ("usage", "out", "state"))
    for months in (["1995-05", "1995-06"], ["1995-07"], []):
        for month in months:
            rows = spark.sql(f"select 'm', timestamp_ntz '{month}-03 10:00:00', 'old bolt', 5L from range(2)").toDF(
                *[c.split()[0] for c in USAGE_SCHEMA.split(", ")]
            )
            rows.write.parquet(f"{base}/{month}")
        ingest_months(spark, base, taxonomy_rows, sessions, STAR, out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.event_date.month for r in rows) == [5, 6, 7] and {r.batch for r in rows} == {0, 1}
