"""Sums of arrays over all rows of a table, added in the tasks first and then in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

# Partial sums that meet in one task or on the driver.
FAN_IN = 16

Arrays = dict[str, np.ndarray]


def packed(arrays: Mapping[str, np.ndarray]) -> bytes:
    return b"".join(np.asarray(arrays[k], np.float64).tobytes() for k in sorted(arrays))


def unpacked(data: bytes, like: Mapping[str, np.ndarray]) -> Arrays:
    flat, result, at = np.frombuffer(data, np.float64), {}, 0
    for k in sorted(like):
        size = np.asarray(like[k]).size
        result[k] = flat[at : at + size].reshape(np.shape(like[k])).copy()
        at += size
    return result


def summed(rows: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], size: int, fan_in: int = FAN_IN) -> np.ndarray:
    """Sum of ``of_batch``, an array of ``size`` numbers, over all batches of ``rows``.

    A task sends one array. While there are more than ``fan_in`` arrays, that many meet in a task, so neither a task nor
    the driver holds more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(d.as_py(), np.float64) for d in table.column("data"))
        return pa.table({"part": table.column("part").slice(0, 1), "data": [total.tobytes()]})

    n = rows.rdd.getNumPartitions()
    partial = rows.mapInArrow(run, "part int, data binary")
    while n > fan_in:
        n = -(-n // fan_in)
        partial = partial.select(F.pmod("part", F.lit(n)).alias("part"), "data").groupBy("part").applyInArrow(add, "part int, data binary")
    # In the order of the parts, so that a run can be repeated to the last digit.
    found = sorted((r["part"], r["data"]) for r in partial.collect())
    return sum((np.frombuffer(d, np.float64) for _, d in found), np.zeros(size))
