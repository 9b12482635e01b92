"""Hard negatives against a plain loop over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwise.llm import negatives
from seatwise.llm.negatives import MiningConfig, hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, score string, cluster string, part int, segment int"
# Several segments, parts and steps on a few hundred rows.
SMALL = MiningConfig(segment=50, members=3, step=16, bins=64)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 1, 2) for i, v, label in rows], SCHEMA).repartition(3)


def plain(rows, is_anchor, config=SMALL):
    """All pairs, by the definition."""
    ready = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ready[i] = (label, [math.floor(config.scale * x) for x in v])
    result = set()
    for a, (label, v) in ready.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m == label) for i, (m, w) in ready.items() if i != a)
        for s, p, _ in [t for t in scored if t[2]][: config.positives]:
            band = [(i, -n) for n, i, same in scored if not same and config.floor * -s <= 100 * -n <= config.ceiling * -s]
            result |= {(a, p, k + 1, i, -s, n) for k, (i, n) in enumerate(band[: config.negatives])}
    return result


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def clustered(seed, n, d=8, groups=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, d))
    labels = rng.integers(0, 4, n)
    return [(i, [float(x) for x in centre[i % groups] + 0.4 * rng.normal(size=d)], int(labels[i])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = clustered(seed, 300)
    result = found(hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, SMALL))
    assert result == plain(rows, lambda i: i % 10 == 0) and result


def test_many_equal_vectors_and_ties(spark):
    """A third of the rows share one vector; ties go by the id."""
    rows = clustered(3, 120) + [(1000 + i, [1.0] * 8, i % 2) for i in range(60)]
    assert found(hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, SMALL)) == plain(rows, lambda i: i % 10 == 0)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.7, 0.0], 2), (3, [0.6], 2), (4, [0.0, 0.0], 1), (5, [], 2), (6, None, 1),
        (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 2), (10, [-1.0, 0.0], 2), (11, [1.0, 0.0], None),
        (None, [1.0, 0.0], 1), (20, [0.0, 0.0], 2), (30, [0.5, -0.5], 3),
    ]
    expected = plain(rows, lambda i: i % 10 == 0)
    assert found(hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, SMALL)) == expected
    assert {(r[0], r[1], r[3]) for r in expected} >= {(0, 1, 2)}


def test_repeated_rows_count_once_and_empty_tables(spark):
    rows = clustered(4, 60)
    assert found(hard_negatives(frame(spark, rows * 2), F.col("vec_id") % 10 == 0, SMALL)) == plain(rows, lambda i: i % 10 == 0)
    assert hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives(frame(spark, rows), F.lit(False)).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(i) / 3, -5.5 * i], i % 3) for i in range(40)]
    assert found(hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, SMALL)) == plain(rows, lambda i: i % 10 == 0)


def test_walk_ends_before_the_list(monkeypatch, spark):
    """With members close to their centre the bound ends a walk long before all pairs are scored."""
    rows = [(i, v, i % 2) for i, v, _ in clustered(5, 400, d=16, groups=20)]
    scored = []
    exact = negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, b, most: scored.append(len(a) * len(b)) or exact(a, b, most))
    import pyarrow as pa

    walk = negatives.Walk(5, True, 16)
    vectors = np.array([[math.floor(256 * x) for x in v] for _, v, _ in rows], np.int64)
    norms = np.linalg.norm(vectors, axis=1)
    member = 0
    centre = vectors[member] / norms[member]
    bound = norms * np.cos(np.maximum(0, np.arccos(np.clip(vectors @ centre / norms, -1, 1)) - 1e-6))
    order = np.argsort(-bound, kind="stable")
    segment = pa.table({
        "ids": [np.array([rows[i][0] for i in order], np.int64).tobytes()], "labels": [np.array([rows[i][2] for i in order], np.int32).tobytes()],
        "bounds": [bound[order].tobytes()], "vectors": [[vectors[i].tobytes() for i in order]],
    })
    targets = [[{"lane": 0, "low": -(2**63), "high": 2**63 - 1}]]
    members = pa.table({"anchor_id": [0], "label": pa.array([0], pa.int32()), "norm": [norms[member]], "vector": [vectors[member].tobytes()], "targets": targets})
    result = walk(segment, members).to_pylist()
    same = sorted((-int(vectors[0] @ vectors[i]), i) for i in range(1, 400) if rows[i][2] == 0)[:5]
    assert [(r["score"], r["vec_id"]) for r in result] == [(-s, i) for s, i in same]
    assert sum(scored) < len(rows) / 2
