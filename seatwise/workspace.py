"""Stage tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; on a local master without one, a scratch folder of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="seatwise-")
    return _local_roots[app]


def own_root(spark: SparkSession) -> str:
    """The folder of this application: all that it stages lies below."""
    return f"{shared_root(spark)}/seatwise/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody else writes to, so that concurrent runs never overwrite each other."""
    return f"{own_root(spark)}/{name}-{uuid4().hex}"


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` and the iterative ML trainers cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{own_root(spark)}/checkpoints")


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder, if it is there, from whatever file system it lies in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _own_tables(spark: SparkSession) -> list[str]:
    """Tables of the current database whose files lie below the folder of this application."""
    own = own_root(spark)
    names = [r["tableName"] for r in spark.sql("show tables").collect() if not r["isTemporary"]]
    found = []
    for name in names:
        rows = spark.sql(f"describe table extended `{name}`").filter("col_name = 'Location'").collect()
        if rows and own in rows[0]["data_type"]:
            found.append(name)
    return found


def close(spark: SparkSession) -> None:
    """Remove what this application has staged, catalog entries included.

    Results that read a stage must have been used or written before.
    """
    for name in _own_tables(spark):
        spark.sql(f"drop table if exists `{name}`")
    delete(spark, own_root(spark))


@contextmanager
def run(spark: SparkSession) -> Iterator[SparkSession]:
    """A run whose stage tables are removed at its end, also after a failure."""
    try:
        yield spark
    finally:
        close(spark)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """In here a query's shuffle files go when it ends, not when the driver collects garbage. For frames that are read once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, name: str, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once and return it as a table scan.

    For a result that several branches of a plan need: written once, each branch then reads only its
    own columns, and a lost executor costs a re-read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_few(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, in tasks of about ``per_task`` rows, but not fewer than there are cores.

    For results that are small beside the number of shuffle partitions, each of which would write a file.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)))
