"""Parquet sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def scan_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A Parquet directory or file; with a schema no footer is read to plan it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_monthly_paths(
    spark: SparkSession, base: str, months: Sequence[str], schema: StructType | str | None = None
) -> DataFrame:
    """The month directories under ``base`` in one scan, so that what follows is planned once."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{base.rstrip('/')}/{month}" for month in months])


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of several tables, copies kept, columns matched by name."""
    for other in others:
        first = first.unionByName(other)
    return first


def write_parquet_overwrite(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Replace the table at ``path``."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def list_input_files(df: DataFrame) -> DataFrame:
    """``(file_path, n_rows)`` of the files that a scan reads, those without rows included.

    The names of all files come from the listing that planned the scan, the counts from the scan.
    """
    counts = df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("n_rows"))
    listed = df.sparkSession.createDataFrame([(path, 0) for path in df.inputFiles()], counts.schema)
    # The listing writes file:///a, the scan file:/a.
    listed = listed.withColumn("file_path", F.regexp_replace("file_path", "^([A-Za-z0-9+.-]+):///", "$1:/"))
    return counts.unionByName(listed).groupBy("file_path").agg(F.sum("n_rows").alias("n_rows"))


def write_split_sets(df: DataFrame, path: str, key: str = "seat_id", parts: int = 64) -> None:
    """One directory per ``split``; reading one split touches only its own directory.

    Rows are dealt over ``parts`` writers per split by a hash of ``key``, so no writer gets a whole split or a whole
    contract, and a split has at most ``parts`` files.
    """
    dealt = df.repartition("split", F.pmod(F.xxhash64(key), parts))
    dealt.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split_set(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == split).drop("split")


def save_intermediate(df: DataFrame, path: str) -> None:
    """Save a stage table keyed by (entity, time step)."""
    write_parquet_overwrite(df, path)


def load_intermediate(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Reload a stage table, reading only the named columns."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(list(columns))
