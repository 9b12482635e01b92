"""Neighbours beside brute force: recall, ties, copies and rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwise.llm import neighbours, queries
from seatwise.llm.neighbours import CurveConfig

SCHEMA = "vec_id bigint, embedding array<float>, score string, rank int, class string, vector int"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, "c", 2) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def brute(vectors, k):
    """Nearest of each query, ties to the smaller id, over the rows that take part."""
    ids = np.array([i for i, _ in vectors])
    rows = np.array([v for _, v in vectors], np.float32).astype(np.float64)
    found = {}
    for n, i in enumerate(ids):
        if i % 20 == 0:
            scores = (rows * rows[n]).sum(axis=1)
            found[int(i)] = [(int(ids[j]), float(scores[j])) for j in np.lexsort((ids, -scores)) if j != n][:k]
    return found


def search(spark, vectors, k=20, config=CurveConfig()):
    got = {}
    for r in neighbours.nearest_neighbours(table(spark, vectors), F.col("vec_id") % 20 == 0, k, config=config).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = {}
    for query, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        found[query] = [r[1:] for r in rows]
    return found


@pytest.mark.parametrize("clustered", [True, False])
def test_recall(spark, clustered):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(3000, 24))
    if clustered:
        rows = rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + 0.1 * rows
    vectors = [(i, v) for i, v in enumerate(rows)]
    got, true = search(spark, vectors, config=CurveConfig(block=64, query_block=16)), brute(vectors, 20)
    assert set(got) == set(true)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in true[q]}) / 20 for q in true])
    assert recall >= 0.9
    exact = {q: dict(rows) for q, rows in brute(vectors, 3000).items()}
    assert all(score == pytest.approx(exact[q][i], abs=1e-12) for q in got for i, score in got[q])


def test_copies_ties_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    copy, other = rng.normal(size=8), rng.normal(size=8)
    vectors = [(i, copy) for i in range(100)] + [(i, other) for i in range(100, 110)] + [(i, rng.normal(size=8)) for i in range(110, 150)]
    odd = [
        (200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [float("inf")] * 8), (280, [1.0, None, *[0.0] * 6]),
        (300, []), (320, [1.0, 2.0]), (None, [1.0] * 8), (0, copy), (1, copy),
    ]
    got = search(spark, vectors + odd)
    assert got == {q: [(i, pytest.approx(s)) for i, s in rows] for q, rows in brute(vectors, 20).items()}


def test_few_and_none(spark):
    assert {q: [i for i, _ in r] for q, r in search(spark, [(0, [1, 0]), (1, [2, 0]), (2, [1, 1])]).items()} == {0: [1, 2]}
    assert search(spark, [(20, [1, 0])]) == {}
    assert search(spark, [(1, [1, 0]), (2, [1, 0])]) == {}
    assert search(spark, [(1, None)]) == {}


def test_hilbert_keys_are_a_walk():
    side = np.arange(8)
    for d in (2, 3):
        cells = np.stack(np.meshgrid(*[side] * d), axis=-1).reshape(-1, d)
        keys = neighbours.hilbert_keys(cells, 3)
        assert sorted(keys) == list(range(8**d))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_registered_query(spark):
    got = queries.QUERIES["op1_neighbours"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")] and got.count() > 0
