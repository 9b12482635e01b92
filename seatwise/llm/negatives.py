"""Hard negatives from candidate lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster with centre c, whose farthest member is at the angle b, a candidate x
has an inner product of at most ``|a| |x| cos(max(0, angle(x, c) - b))`` with any member a. The candidates are sorted by
this bound, without ``|a|``, once for each cluster, and every member walks the list: it scores the next rows until the
bound times ``|a|`` falls below the last score that it keeps. What follows cannot be better, so the result is exact.

A list is cut into segments of a bounded number of rows, each packed in list order into one row of a stage table. Cuts
come from a histogram of the bounds, summed in the tasks; rows of a bin that is too full, such as equal vectors, are
dealt by a hash of the id. The members of a cluster are dealt into parts. One task walks one segment with one part:
first the heads of all lists, which give each member a limit, then the segments that reach the member's limit.

Two walks: the best rows of the anchor's own label are its positives; then, for each positive, the best rows of
other labels whose score lies in a band set by the positive's score.

Vectors are scaled and floored to whole numbers, so scores are exact; they must fit a long. ``fit_anchors`` bounds the
anchors that place the cluster centres; all anchors and rows take part in everything else. Vectors without structure have
bounds that cut nothing, and then all segments are walked, in blocks.

Results by case: rows with a NULL id, label or vector or any NULL or non-finite component take no part; a shorter vector
counts as filled up with zeros; zero vectors score 0; of rows with the same id the one with the least label, then the least
packed vector counts; equal scores go by the smaller id; an anchor without positives or a positive without negatives has no
rows; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from seatwise.workspace import stage


@dataclass(frozen=True)
class MiningConfig:
    """``floor`` and ``ceiling`` are hundredths of the positive's score between which a negative's score lies."""

    scale: int = 256
    positives: int = 5
    negatives: int = 3
    floor: int = 50
    ceiling: int = 95
    clusters: int = 4
    fit_anchors: int = 4096
    bins: int = 2048
    segment: int = 4096
    members: int = 1024
    step: int = 256


_RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
_LIST = "cluster int, segment int, top double, ids binary, labels binary, bounds binary, vectors array<binary>"
_FOUND = "anchor_id bigint, lane int, score bigint, vec_id bigint"


def matrix(vectors: list[bytes], width: int | None = None) -> np.ndarray:
    """Packed vectors as rows, filled up with zeros to the longest or to ``width``."""
    lengths = [len(v) // 8 for v in vectors]
    width = max(lengths, default=0) if width is None else width
    if lengths and min(lengths) == max(lengths) == width:
        return np.frombuffer(b"".join(vectors), np.int64).reshape(len(vectors), width)
    rows = np.zeros((len(vectors), width), np.int64)
    for row, v, n in zip(rows, vectors, lengths, strict=True):
        row[:n] = np.frombuffer(v, np.int64)
    return rows


def products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of the rows; ``largest`` bounds them and all their partial sums."""
    if largest < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def quantised(rows: DataFrame, anchor: Column, config: MiningConfig) -> DataFrame:
    """``(vec_id, label, anchor, norm, vector)``: one row for each id that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.floor(config.scale * np.asarray(v, np.float64)).astype(np.int64) for v in batch.column("vector").to_pylist()]
            norms = [float(np.sqrt((v.astype(np.float64) ** 2).sum())) for v in values]
            columns = [*(batch.column(c) for c in ("vec_id", "label", "anchor")), pa.array(norms, pa.float64()), pa.array([v.tobytes() for v in values], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "anchor", "norm", "vector"])

    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    read = rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("vector"),
    )
    read = read.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)
    packed = read.mapInArrow(run, "vec_id bigint, label int, anchor boolean, norm double, vector binary")
    one = F.min(F.struct("label", "vector", "norm", "anchor")).alias("r")
    return packed.groupBy("vec_id").agg(one).select("vec_id", "r.label", "r.anchor", "r.norm", "r.vector")


def centres(sample: np.ndarray, n: int, turns: int = 10) -> np.ndarray:
    """Directions of at most ``n`` clusters: spherical k-means from far-apart starts."""
    lengths = np.linalg.norm(sample, axis=1)
    unit = sample[lengths > 0] / lengths[lengths > 0, None]
    if not len(unit):
        return np.zeros((1, sample.shape[1]))
    chosen = unit[:1]
    while len(chosen) < min(n, len(unit)):
        nearest = (unit @ chosen.T).max(axis=1)
        if nearest.min() > 1 - 1e-9:
            break
        chosen = np.vstack([chosen, unit[nearest.argmin()]])
    for _ in range(turns):
        member = (unit @ chosen.T).argmax(axis=1)
        sums = np.array([unit[member == k].sum(axis=0) for k in range(len(chosen))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        chosen = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), chosen)
    return chosen


def angles(vectors: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of each row to each direction; 0 for zero vectors."""
    cosines = vectors.astype(np.float64) @ directions.T / np.where(norms > 0, norms, 1)[:, None]
    return np.where(norms[:, None] > 0, np.arccos(np.clip(cosines, -1, 1)), 0.0)


def assigned(anchors: DataFrame, directions: np.ndarray, config: MiningConfig) -> DataFrame:
    """Anchors with their ``cluster`` and the ``angle`` to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = angles(matrix(batch.column("vector").to_pylist(), directions.shape[1]), batch.column("norm").to_numpy(), directions)
            columns = [*batch.columns, pa.array(found.argmin(axis=1), pa.int32()), pa.array(found.min(axis=1), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cluster", "angle"])

    columns = "anchor_id bigint, label int, norm double, vector binary, cluster int, angle double"
    return anchors.select(F.col("vec_id").alias("anchor_id"), "label", "norm", "vector").mapInArrow(run, columns)


@dataclass(frozen=True)
class Bounds:
    """Upper bounds of candidates by cluster: ``reach`` is the angle of each cluster's farthest member."""

    directions: np.ndarray
    reach: np.ndarray
    largest: float
    bins: int

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Bounds and their bins, rows by clusters; the first bin has the largest bounds."""
        norms = batch.column("norm").to_numpy()
        away = angles(matrix(batch.column("vector").to_pylist(), self.directions.shape[1]), norms, self.directions)
        # A little more than the bound, for rounding.
        bounds = norms[:, None] * (np.cos(np.clip(away - self.reach - 1e-7, 0, np.pi)) + 1e-9)
        place = (self.largest - bounds) / (2 * self.largest) * self.bins
        return bounds, np.clip(place, 0, self.bins - 1).astype(np.int64)


def histogram(rows: DataFrame, bounds: Bounds) -> np.ndarray:
    """Rows by cluster and bin, added up in the tasks and then in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(bounds.directions), bounds.bins), np.int64)
        for batch in batches:
            _, places = bounds.of(batch)
            for cluster, place in enumerate(places.T):
                counts[cluster] += np.bincount(place, minlength=bounds.bins)
        at = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[at[:, 0], at[:, 1]], pa.int64())], ["cluster", "bin", "n"]
        )

    counts = np.zeros((len(bounds.directions), bounds.bins), np.int64)
    # At most clusters * bins rows.
    for row in rows.mapInArrow(run, "cluster int, bin int, n bigint").groupBy("cluster", "bin").agg(F.sum("n").alias("n")).collect():
        counts[row["cluster"], row["bin"]] = row["n"]
    return counts


def cuts(counts: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """First segment and number of segments of each bin of each cluster: light bins share one, heavy ones have several."""
    first, parts = np.zeros_like(counts), np.ones_like(counts)
    for cluster, row in enumerate(counts):
        at, held = 0, 0
        for place, n in enumerate(row):
            if held and held + n > segment:
                at, held = at + 1, 0
            first[cluster, place] = at
            if n > segment:
                parts[cluster, place] = -(-n // segment)
                at, held = at + int(parts[cluster, place]), 0
            else:
                held += n
    return first, parts


def packed_lists(rows: DataFrame, bounds: Bounds, config: MiningConfig) -> DataFrame:
    """One row for each segment of each cluster's list, its candidates in list order."""
    first, parts = cuts(histogram(rows, bounds), config.segment)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, places = bounds.of(batch)
            ids = batch.column("vec_id").to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for cluster in range(len(bounds.directions)):
                place = places[:, cluster]
                segment = first[cluster, place] + mixed.astype(np.int64) % parts[cluster, place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), cluster), pa.int32()), pa.array(segment, pa.int32()), batch.column("vec_id"), batch.column("label"), pa.array(values[:, cluster]), batch.column("vector")],
                    ["cluster", "segment", "vec_id", "label", "bound", "vector"],
                )

    def pack(table: pa.Table) -> pa.Table:
        bound, ids = table.column("bound").to_numpy(), table.column("vec_id").to_numpy()
        order = np.lexsort((ids, -bound))
        columns = {
            "cluster": table.column("cluster").to_pylist()[:1], "segment": table.column("segment").to_pylist()[:1], "top": [float(bound.max())],
            "ids": [ids[order].tobytes()], "labels": [table.column("label").to_numpy()[order].tobytes()], "bounds": [bound[order].tobytes()],
            "vectors": [table.column("vector").take(pa.array(order)).to_pylist()],
        }
        types = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
        return pa.table([pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)], names=list(columns))

    spread = rows.mapInArrow(listed, "cluster int, segment int, vec_id bigint, label int, bound double, vector binary")
    return spread.groupBy("cluster", "segment").applyInArrow(pack, _LIST)


@dataclass(frozen=True)
class Walk:
    """Walks one segment with some members, each of which has lanes: bands of scores of which the best ``keep`` rows are
    wanted, of the member's own label (``same``) or of others."""

    keep: int
    same: bool
    step: int

    def __call__(self, segment: pa.Table, members: pa.Table) -> pa.Table:
        if not segment.num_rows or not members.num_rows:
            return _found([], [], [], [])
        ids, labels, bounds = (np.frombuffer(segment.column(c)[0].as_py(), t) for c, t in (("ids", np.int64), ("labels", np.int32), ("bounds", np.float64)))
        packed, own = segment.column("vectors")[0].as_py(), members.column("vector").to_pylist()
        width = max(len(v) for v in [*packed, *own]) // 8
        candidates, vectors = matrix(packed, width), matrix(own, width)
        anchors, label, norm = (members.column(c).to_numpy() for c in ("anchor_id", "label", "norm"))
        largest = float(norm.max()) * float(np.sqrt((candidates.astype(np.float64) ** 2).sum(axis=1)).max())
        lanes = [(m, t["lane"], t["low"], t["high"]) for m, targets in enumerate(members.column("targets").to_pylist()) for t in targets]
        owner, lane, limit, high = (np.array(c, np.int64) for c in zip(*lanes, strict=True))
        best = np.zeros((3, 0), np.int64)  # lane number, score, place in the list
        for start in range(0, len(ids), self.step):
            live = np.flatnonzero(bounds[start] * norm[owner] * (1 + 1e-9) + 1e-6 >= limit)
            if not len(live):
                break
            walking, at = np.unique(owner[live], return_inverse=True)
            rows = slice(start, start + self.step)
            scores = products(vectors[walking], candidates[rows], largest)
            fits = ((labels[rows] == label[walking][:, None]) == self.same) & (ids[rows] != anchors[walking][:, None])
            hit = fits[at] & (scores[at] >= limit[live][:, None]) & (scores[at] <= high[live][:, None])
            which, place = np.nonzero(hit)
            if not len(which):
                continue
            new = np.array([live[which], scores[at[which], place], place + start])
            best = np.concatenate([best, new], axis=1)
            best = best[:, np.lexsort((ids[best[2]], -best[1], best[0]))]
            begin = np.flatnonzero(np.concatenate([[True], best[0, 1:] != best[0, :-1]]))
            rank = np.arange(best.shape[1]) - np.repeat(begin, np.diff(np.concatenate([begin, [best.shape[1]]])))
            best = best[:, rank < self.keep]
            full = best[:, rank[rank < self.keep] == self.keep - 1]
            limit[full[0]] = full[1]
        return _found(anchors[owner[best[0]]], lane[best[0]], best[1], ids[best[2]])


def _found(*columns) -> pa.Table:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor_id", "lane", "score", "vec_id"])


def best(found: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` rows of each lane with their ``rank``."""
    order = Window.partitionBy("anchor_id", "lane").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def met(lists: DataFrame, members: DataFrame, segments: Column, walk: Walk) -> DataFrame:
    """What the members find in those of the segments that can still hold something for them."""
    keys = ["cluster", "segment", "part"]
    lowest = F.array_min(F.transform("targets", lambda t: t["low"]))
    reached = F.col("top") * F.col("norm") * (1 + 1e-9) + 1e-6 >= lowest
    wanted = members.join(lists.filter(segments).select("cluster", "segment", "top"), "cluster").filter(reached).drop("top")
    # Only segments that a part of the members wants, copied to these parts.
    copies = lists.filter(segments).join(wanted.select(*keys).distinct(), keys[:2])
    copies = copies.toDF(*copies.columns)  # own columns beside those of the other side
    run = copies.groupBy(*keys).cogroup(wanted.groupBy(*keys))
    return run.applyInArrow(lambda segment, part: walk(segment, part), _FOUND)


def walked(lists: DataFrame, members: DataFrame, walk: Walk) -> DataFrame:
    """The best rows of every lane over whole lists: the heads first, then what the limits found there leave."""
    heads = stage(best(met(lists, members, F.col("segment") == 0, walk), walk.keep).drop("rank"), "heads")
    full = heads.groupBy("anchor_id", "lane").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == walk.keep)
    # One entry for each lane of a member.
    limits = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("lane", "least"))).alias("limits"))
    raised = F.transform("targets", lambda t: F.struct(t["lane"].alias("lane"), F.greatest(t["low"], F.col("limits")[t["lane"]]).alias("low"), t["high"].alias("high")))
    after = members.join(limits, "anchor_id", "left")
    after = after.withColumn("targets", F.when(F.col("limits").isNull(), F.col("targets")).otherwise(raised)).drop("limits")
    rest = met(lists, after, F.col("segment") > 0, walk)
    return stage(best(heads.unionByName(rest), walk.keep), "walked")


def hard_negatives(rows: DataFrame, anchor: Column, config: MiningConfig = MiningConfig()) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows ``(vec_id, embedding,
    label)`` where ``anchor`` holds, against all rows."""
    spark = rows.sparkSession
    ready = stage(quantised(rows, anchor, config), "vectors")
    anchors = ready.filter("anchor")
    # Bounded by fit_anchors: only centres come of it.
    sample = [r["vector"] for r in anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(config.fit_anchors).select("vector").collect()]
    if not sample:
        return spark.createDataFrame([], _RESULT)
    size = ready.agg(F.max("norm").alias("norm"), F.max(F.octet_length("vector")).alias("bytes")).first()
    directions = centres(matrix(sample, size["bytes"] // 8).astype(np.float64), config.clusters)

    near = stage(assigned(anchors, directions, config), "anchors")
    reach, parts = np.zeros(len(directions)), np.ones(len(directions), int)
    for row in near.groupBy("cluster").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():
        reach[row["cluster"]], parts[row["cluster"]] = row["angle"], -(-row["n"] // config.members)
    lists = stage(packed_lists(ready, Bounds(directions, reach, max(size["norm"] * (1 + 1e-6), 1.0), config.bins), config), "lists")

    n_parts = F.array(*[F.lit(int(n)) for n in parts])[F.col("cluster")]
    members = near.withColumn("part", F.pmod(F.xxhash64("anchor_id"), n_parts).cast("int")).drop("angle")
    everything = F.array(F.struct(F.lit(0).alias("lane"), F.lit(-(2**63)).cast("bigint").alias("low"), F.lit(2**63 - 1).cast("bigint").alias("high")))
    positives = walked(lists, members.withColumn("targets", everything), Walk(config.positives, True, config.step))
    positives = positives.select("anchor_id", F.col("rank").alias("lane"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    band = positives.withColumns({
        "low": F.expr(f"({config.floor} * positive_score + 99) div 100"), "high": F.expr(f"{config.ceiling} * positive_score div 100"),
    })
    # Below 0 the band is empty.
    band = band.filter((F.col("positive_score") >= 0) & (F.col("low") <= F.col("high")))
    targets = band.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("lane", "low", "high"))).alias("targets"))
    negatives = walked(lists, members.join(targets, "anchor_id"), Walk(config.negatives, False, config.step))
    joined = negatives.join(positives, ["anchor_id", "lane"])
    return joined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


# The same over the embeddings table, all pairs compared; fixed values stand in for MiningConfig's defaults.
NEGATIVES_SQL = """
with ready as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.v, r.v) as bigint) as score
  from ready a join ready r on a.vec_id <> r.vec_id where a.vec_id % 50 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over w as integer) as rank, n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
  and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id)
qualify row_number() over w <= 3
"""
