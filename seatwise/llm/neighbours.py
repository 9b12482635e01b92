"""Approximate nearest neighbours by shifted space-filling curves.

Each vector is projected, shifted and put in order along several Hilbert curves. Spark range-partitions the keys of each
curve, which gives every vector its rank on it. A query looks at the vectors whose rank is within a window of its own on
any curve; the windows of all curves are merged and ranked by the exact inner product in double precision.

The window is not a constant: a sample of queries is searched exactly, in blocks, and the window becomes the one that would
have found the wanted share of their neighbours. Clustered vectors get narrow windows; vectors without any structure
need wide ones. Every vector is on every curve, so nothing is left out of the index.

Equal vectors are one class, searched once; a class keeps its ``k + 1`` smallest ids, which are all that can be returned.

Results by case: vectors that are NULL, zero, not finite, with a NULL component or without an id take no part, nor do
vectors of another length than most (the shorter, if equally many); of rows that share an id the smallest
vector counts; with fewer than ``k`` candidates all are returned; without queries or vectors the result is empty. Only
the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from seatwise.workspace import stage


@dataclass(frozen=True)
class CurveConfig:
    """``fit_rows`` vectors set the range of the projections and ``fit_queries`` queries the window; ``block`` ranks make
    a task's share; ``recall`` is the share of true neighbours that the window must have reached on the sample."""

    curves: int = 16
    dimensions: int = 4
    bits: int = 15
    fit_rows: int = 2000
    fit_queries: int = 100
    recall: float = 0.96
    block: int = 4096
    query_block: int = 512
    seed: int = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates below ``2 ** bits``.

    From the highest bit down, coordinates are brought into the frame of the sub-cube they are in, then Gray-coded.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            inside = (x[i] >> bit) & 1 == 1
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


@dataclass(frozen=True)
class Curves:
    """Projections, ranges and shifts of all curves."""

    config: CurveConfig
    axes: np.ndarray
    low: np.ndarray
    width: np.ndarray
    shift: np.ndarray

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """One key for each vector and curve. A shifted curve sees the data in another part of its cube."""
        c = self.config
        unit = np.clip((vectors @ self.axes - self.low) / self.width, 0, 1)
        cells = ((unit + self.shift) / 2 * (2**c.bits - 1)).astype(np.int64)
        d = c.dimensions
        return np.stack([hilbert_keys(cells[:, i * d : (i + 1) * d], c.bits) for i in range(c.curves)], axis=1)


def fit_curves(sample: np.ndarray, config: CurveConfig) -> Curves:
    rng = np.random.default_rng(config.seed)
    size, wanted = sample.shape[1], config.curves * config.dimensions
    turns = [np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(-(-wanted // size))]
    axes = np.concatenate(turns, axis=1)[:, :wanted]
    seen = sample @ axes
    low, high = seen.min(0), seen.max(0)
    return Curves(config, axes, low, np.where(high > low, high - low, 1.0), rng.random(wanted))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).combine_chunks()
    return chunks if isinstance(chunks, pa.Array) else chunks.chunk(0)


def nearest(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """``(query id, row id, score)`` of the ``k`` best rows other than its own for each query, ties to the smaller id.

    The product of matrices only picks rows; scores are summed row by row, so that equal vectors have equal scores.
    """
    products = queries @ rows.T
    products[own[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:
        limits = np.partition(products, len(ids) - k, axis=1)[:, len(ids) - k]
    else:
        limits = np.full(len(own), -np.inf)
    for q, limit in enumerate(limits):
        near = np.flatnonzero((products[q] >= limit - 1e-9 * (1 + abs(limit))) if np.isfinite(limit) else np.isfinite(products[q]))
        scores = (rows[near] * queries[q]).sum(axis=1)
        for i in np.lexsort((ids[near], -scores))[:k]:
            yield int(own[q]), int(ids[near[i]]), float(scores[i])


def _found(rows: list[tuple[int, int, float]]) -> list[pa.Array]:
    q, i, s = zip(*rows, strict=True) if rows else ((), (), ())
    return [pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())]


_FOUND = "query long, class long, score double"
_NAMES = ["query", "class", "score"]


def searcher(k: int, batch: int) -> Callable[[pa.Table], pa.Table]:
    """A group's queries against its rows, ``batch`` queries at a time."""

    def search(table: pa.Table) -> pa.Table:
        asks = _column(table, "asks").to_numpy(zero_copy_only=False)
        ids, vectors = _column(table, "class").to_numpy(), _matrix(_column(table, "vector"))
        rows, row_ids = vectors[~asks], ids[~asks]
        own, asked = ids[asks], vectors[asks]
        found: list[tuple[int, int, float]] = []
        for at in range(0, len(own) if len(row_ids) else 0, batch):
            found += nearest(asked[at : at + batch], own[at : at + batch], rows, row_ids, k)
        return pa.Table.from_arrays(_found(found), names=_NAMES)

    return search


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query among all that were found, each once."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    once = found.groupBy("query", "class").agg(F.max("score").alias("score"))
    return once.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(vec_id, vector)``: the rows that take part, one for each id."""
    vector = F.col(vector_column).cast("array<double>")
    read = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector")).filter(
        F.col("vec_id").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    lengths = read.groupBy(F.size("vector").alias("length")).count()
    length = lengths.select(F.max_by("length", F.struct("count", -F.col("length")))).first()[0]
    return read.filter(F.size("vector") == F.lit(length)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def smallest_ids(rows: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """The ``k`` smallest ids of each class, first within parts of a class, then of the class."""
    part = F.pmod(F.xxhash64("vec_id"), salts)
    first = Window.partitionBy("class", "_part").orderBy("vec_id")
    then = Window.partitionBy("class").orderBy("vec_id")
    parts = rows.withColumn("_part", part).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k)
    return parts.withColumn("_n", F.row_number().over(then)).filter(F.col("_n") <= k).select("class", "vec_id")


def ranked(keys: DataFrame) -> DataFrame:
    """Add ``rank`` on each curve: rows are range-partitioned and sorted, then counts of partitions are summed up."""
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(n, "curve", "key", "class").sortWithinPartitions("curve", "key", "class")
    placed = stage(ordered.withColumn("_at", F.monotonically_increasing_id()), "curves")
    # The upper bits of _at are the partition: one row for each partition and curve.
    parts = placed.groupBy("curve", F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy("curve").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    joined = placed.withColumn("_part", F.shiftright("_at", 33)).join(parts, ["curve", "_part"])
    return joined.select("curve", "class", "asks", (F.col("_before") + F.col("_at") - F.col("_first")).alias("rank"))


def calibrated_window(classes: DataFrame, ranks: DataFrame, k: int, config: CurveConfig) -> int:
    """The least rank distance that reaches the wanted recall for a sample of queries, searched exactly."""
    spark = classes.sparkSession
    sample = classes.filter("asks").orderBy(F.xxhash64("class"), "class").limit(config.fit_queries).select("class", "vector").collect()
    if not sample:
        return 0
    own = np.array([r["class"] for r in sample], np.int64)
    shared = spark.sparkContext.broadcast((own, np.array([r["vector"] for r in sample])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = shared.value
        for batch in batches:
            if batch.num_rows:
                found = list(nearest(asked, own, _matrix(batch.column("vector")), batch.column("class").to_numpy(), k))
                yield pa.RecordBatch.from_arrays(_found(found), _NAMES)

    true = best(classes.select("class", "vector").mapInArrow(run, _FOUND), k)
    # At most fit_queries times k pairs.
    pairs = F.broadcast(true.select("query", "class"))
    here = ranks.select("curve", "class", "rank").join(pairs, "class")
    there = ranks.join(F.broadcast(spark.createDataFrame([(int(c),) for c in own], "query long")), F.col("class") == F.col("query"))
    both = here.join(F.broadcast(there.select("curve", "query", F.col("rank").alias("own"))), ["curve", "query"])
    gaps = both.groupBy("query", "class").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("gap"))
    window = gaps.agg(F.expr(f"percentile_disc({config.recall}) within group (order by gap)")).first()[0]
    return int(window or 0)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    config: CurveConfig = CurveConfig(),
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows where ``is_query``, an expression over ``vec_id``, holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    key = F.concat_ws(":", F.xxhash64("vector"), F.xxhash64("vector", F.lit(1)))
    keyed = stage(rows.select("vec_id", "vector", key.alias("_key"), is_query.alias("asks")), "vectors")
    classes = stage(
        keyed.groupBy("_key").agg(
            F.min("vec_id").alias("class"), F.first("vector").alias("vector"), F.max("asks").alias("asks"),
            F.sum(F.col("asks").cast("long")).alias("n_asks"),
        ),
        "classes",
    )
    sample = classes.orderBy(F.xxhash64("class", F.lit(1)), "class").limit(config.fit_rows).select("vector").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(fit_curves(np.array([r["vector"] for r in sample]), config))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = shared.value.keys(_matrix(batch.column("vector"))) if batch.num_rows else np.zeros((0, config.curves), np.int64)
            n = config.curves
            ids = np.repeat(batch.column("class").to_numpy(), n)
            asks = np.repeat(batch.column("asks").to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows)), pa.array(keys.ravel()), pa.array(ids), pa.array(asks)],
                ["curve", "key", "class", "asks"],
            )

    keys = classes.select("class", "vector", "asks").mapInArrow(keys_of, "curve int, key long, class long, asks boolean")
    ranks = stage(ranked(keys), "ranks")
    window = calibrated_window(classes, ranks, k, config)

    # Rows stay in their block; a query goes to each block that its window touches. Wide windows bring many queries to a
    # block, so they are dealt over parts of it, which bounds a group.
    parts = 1 + 2 * window // 500_000
    block = lambda rank: F.floor(rank / F.lit(config.block))
    copies = ranks.select("curve", "class", F.lit(False).alias("asks"), block(F.col("rank")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    reach = F.sequence(block(F.greatest(F.col("rank") - window, F.lit(0))), block(F.col("rank") + window))
    sent = ranks.filter("asks").select("curve", "class", "asks", F.explode(reach).alias("block"), F.pmod(F.xxhash64("class"), parts).cast("int").alias("part"))
    placed = copies.unionByName(sent).join(classes.select("class", "vector"), "class")
    found = placed.groupBy("curve", "block", "part").applyInArrow(searcher(k, config.query_block), _FOUND)

    # The members of the classes found, and those of the query's own class.
    own = classes.filter("asks").select(
        F.col("class").alias("query"), "class", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x).alias("score")
    )
    members = smallest_ids(keyed.join(classes.select("_key", "class"), "_key").select("class", "vec_id"), k + 1)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = (
        best(found, k).unionByName(own).join(members, "class")
        .withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
        .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("_list"))
    )
    # A class with very many queries is copied, and its queries are dealt over the copies.
    shares = classes.filter("asks").select("_key", F.col("class").alias("query"), (1 + F.col("n_asks") / 1000).cast("int").alias("_shares"))
    copied = listed.join(shares, "query").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    asking = keyed.filter("asks").select("vec_id", "_key").withColumnRenamed("vec_id", "query_id")
    dealt = asking.join(shares.select("_key", "_shares"), "_key").withColumn("_share", F.pmod(F.xxhash64("query_id"), F.col("_shares")).cast("int"))
    answers = dealt.drop("_shares").join(copied.select("_key", "_share", "_list"), ["_key", "_share"])
    others = F.slice(F.filter("_list", lambda x: x["vec_id"] != F.col("query_id")), F.lit(1), F.lit(k))
    return answers.select("query_id", F.posexplode(others).alias("_place", "_found")).select(
        "query_id", (F.col("_place") + 1).cast("int").alias("rank"), F.col("_found.vec_id").alias("vec_id"), F.col("_found.score").alias("score")
    )
