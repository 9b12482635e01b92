"""Classes of near duplicates beside brute force over all pairs."""

import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from seatwise import workspace
from seatwise.llm import near_dup
from seatwise.llm.near_dup import NearDupConfig
from seatwise.llm.text import words
from tests.llm.helpers import documents, plain_words


def shingles(text):
    words = plain_words(text)
    counts = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
    return {k: 1 + math.log(c) for k, c in counts.items()}


def similarity(a, b):
    p, q = ({k: w / sum(x.values()) for k, w in x.items()} for x in (a, b))
    every = set(p) | set(q)
    return sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in every) for i in set(p) & set(q))


def classes(rows):
    """Smallest id of each row's component; rows without words apart."""
    weights = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if weights[i] and weights[j] and find(i) != find(j) and similarity(weights[i], weights[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((m for m in ms if m is not None), default=None) for r, ms in members.items()}
    return [rows[i][0] if not weights[i] else least[find(i)] for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [[word() for _ in range(120)] for _ in range(6)]
    rows = [(1, None, "s"), (2, None, "s"), (3, "", "s"), (4, "...", None), (5, "one two", "s"), (6, "One, TWO!", "s"), (7, "two one", "s")]
    for b in base:
        for edits in (0, 0, 1, 2, 3, 6, 12):
            text = list(b)
            for _ in range(edits):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows) + 1, " ".join(text), "s"))
    # A chain: each text is near the next only.
    text = [word() for _ in range(150)]
    for _ in range(12):
        rows.append((len(rows) + 1, " ".join(text), "s"))
        for _ in range(3):
            text[rng.randrange(len(text))] = word()
    rows += [(None, rows[7][1], None), (9, rows[8][1], "s"), (9, rows[8][1], "s"), (200, "long " * 30000 + "tail", "s"), (201, "long " * 30000 + "tail", "s")]
    return rows


@pytest.mark.parametrize("config", [NearDupConfig(), NearDupConfig(block=3)])
def test_classes_equal_brute_force(spark, rows, config):
    got = near_dup.near_duplicates(documents(spark, rows), config=config).collect()
    expected = Counter((r[0], c) for r, c in zip(rows, classes(rows), strict=True))
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == expected


def test_blocks_of_the_last_round_and_small_batches(spark, rows):
    """Blocks of the signatures go on over batches; texts outside the largest class meet the other blocks in parts."""
    name, config = "spark.sql.execution.arrow.maxRecordsPerBatch", NearDupConfig(block=3, late_block=2, late_bytes=3000)
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "4")
        got = near_dup.near_duplicates(documents(spark, rows), config=config).collect()
    finally:
        spark.conf.set(name, before)
    expected = Counter((r[0], c) for r, c in zip(rows, classes(rows), strict=True))
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == expected


def block(texts, band):
    """A block of ``merger`` with the texts, each in a class of its own."""
    config = NearDupConfig()
    coded = [t.encode() for t in texts]
    owner, value, weight = near_dup.weighted(*near_dup.text_shingles(coded, config.shingle))
    signs = near_dup.prob_minhash(owner, value, weight, len(texts), config.registers)
    each = [(value[owner == k], weight[owner == k]) for k in range(len(texts))]
    return signs, pa.table({
        "class": [f"{k:03}" for k in range(len(texts))], "band": pa.array([band] * len(texts), pa.int32()), "signature": [s.tobytes() for s in signs],
        "value": [v.tobytes() for v, _ in each], "heavy": [np.flatnonzero(w > 1).astype(np.uint32).tobytes() for _, w in each], "weight": [w[w > 1].tobytes() for _, w in each],
    })


def test_a_pair_is_verified_in_one_bucket_only(monkeypatch):
    """Texts that are somewhat alike share many buckets; their number of comparisons must not grow with the buckets."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(30):
        text = list(base)
        for place in rng.sample(range(300), 7):
            text[place] = f"v{rng.randrange(10**9)}"
        texts.append(" ".join(text))
    seen, exact = Counter(), []
    bounds, jaccard = near_dup.bounds, near_dup.probability_jaccard
    monkeypatch.setattr(near_dup, "bounds", lambda *x: (seen.update(zip(x[4].tolist(), x[5].tolist(), strict=True)), bounds(*x))[1])
    monkeypatch.setattr(near_dup, "probability_jaccard", lambda *x: (exact.append(x), jaccard(*x))[1])
    shared = Counter()
    for band in range(20):
        signs, table = block(texts, band)
        part = signs[:, 4 * band : 4 * band + 4]
        for k in {tuple(r) for r in part.tolist()}:
            here = np.flatnonzero((part == k).all(axis=1))
            shared.update((int(i), int(j)) for i in here for j in here if i < j)
            if len(here) > 1:
                seen, found = Counter(), seen
                merged = near_dup.merger(NearDupConfig())(table.take(here))
                seen = found + Counter({(int(here[i]), int(here[j])): n for (i, j), n in seen.items()})
                assert merged.num_rows == 0
    assert sum(shared.values()) > 2 * len(shared)
    assert max(seen.values()) == 1 and len(seen) > 0.9 * len(shared) and not exact


def test_merged_pairs_need_no_look(monkeypatch):
    text = " ".join(f"w{i}" for i in range(400))
    _, table = block([f"{text} x{k}" for k in range(60)], 0)
    bounds, seen = near_dup.bounds, []
    monkeypatch.setattr(near_dup, "bounds", lambda *x: (seen.append(len(x[4])), bounds(*x))[1])
    merged = near_dup.merger(NearDupConfig())(table)
    assert set(merged["v"].to_pylist()) == {"000"} and merged.num_rows == 59
    assert sum(seen) < 60 * 59 / 4


def test_bounds_enclose_the_probability_jaccard():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["one", "two"], k=rng.randrange(1, 200))) for _ in range(20)] + [" ".join(map(str, range(k, 50))) for k in range(8)]
    _, table = block(texts, 0)
    value, weight, cuts = near_dup.read_shingles(table)
    distinct, codes = np.unique(value, return_inverse=True)
    i, j = np.triu_indices(len(texts), 1)
    low, high = near_dup.bounds(codes, weight, cuts, len(distinct), i, j)
    exact = np.array([similarity(shingles(texts[a]), shingles(texts[b])) for a, b in zip(i, j, strict=True)])
    assert (low <= exact + 1e-9).all() and (exact <= high + 1e-9).all() and (high > low + 0.01).any()
    same = (i >= 20) & (j >= 20)  # all weights 1
    assert low[same] == pytest.approx(exact[same], abs=1e-9) and high[same] == pytest.approx(exact[same], abs=1e-9)


def test_words_of_bytes_are_the_words_of_texts():
    rng = random.Random(4)
    chars = ["a", "B", "z", "Z", "0", "9", " ", ".", "/", ":", "@", "[", "`", "{", "\x7f", "\x00", "é", "ß", "İ", "漢", "😀", " "]
    texts = ["".join(rng.choices(chars, k=rng.randrange(50))) for _ in range(2000)] + ["", ".", "x" * 37 + " " + "x" * 38]
    value, lengths = near_dup.word_hashes([t.encode() for t in texts])
    found = [w for t in texts for w in words(t)]
    assert lengths.tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(found, value.tolist(), strict=True))) == len(set(found)) == len(set(value.tolist()))


def test_one_of_each_class_stays(spark, rows):
    docs = documents(spark, rows)
    left = near_dup.without_near_duplicates(docs)
    assert left.columns == docs.columns
    groups = {}
    for i, (row, c) in enumerate(zip(rows, classes(rows), strict=True)):
        groups.setdefault(("alone", i) if not plain_words(row[1]) else c, []).append(row)
    stay = Counter((r[0], r[1]) for r in (min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == stay


def test_small_stages_are_few_files(spark, rows, tmp_path, monkeypatch):
    """Each file costs a process on a local file system; a stage of a few rows is not one file for each shuffle partition."""
    monkeypatch.setattr(workspace, "new_path", lambda spark, name: f"{tmp_path}/{name}-{len([*tmp_path.iterdir()])}")
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        near_dup.without_near_duplicates(documents(spark, rows)).write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {stage.name: len([*stage.glob("part-*")]) for stage in tmp_path.iterdir()}
    assert {name.split("-")[0] for name in files} >= {"members", "texts", "star", "classes", "labelled", "out"}
    assert max(files.values()) <= spark.sparkContext.defaultParallelism, files


def test_signatures_estimate_the_probability_jaccard():
    rng = random.Random(1)
    a = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(500)]
    b = a[:420] + [str(i) for i in range(80)]
    owner, value, weight = near_dup.weighted(*near_dup.shingle_hashes([a, b, a * 2], 5))
    cut = np.searchsorted(owner, np.arange(4))
    signs = near_dup.prob_minhash(owner, value, weight, 3, 6000)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        x, y = slice(cut[i], cut[i + 1]), slice(cut[j], cut[j + 1])
        exact = near_dup.probability_jaccard(value[x], weight[x], value[y], weight[y])
        texts = [a, b, a * 2]
        assert exact == pytest.approx(similarity(shingles(" ".join(texts[i])), shingles(" ".join(texts[j]))), abs=1e-9)
        assert (signs[i] == signs[j]).mean() == pytest.approx(exact, abs=0.03)


def test_components_of_paths_and_stars(spark):
    links = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("z", f"y{i}") for i in range(30)] + [("q", "q"), ("a", "b"), ("b", "a")]
    got = {r["node"]: r["root"] for r in near_dup.components(spark.createDataFrame(links, "u string, v string")).collect()}
    assert {got[f"{i:03}"] for i in range(1, 61)} == {"000"} and got["b"] == "a" and got["z"] == "y0" and "q" not in got


def test_empty_table(spark):
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0
    assert near_dup.without_near_duplicates(documents(spark, [])).count() == 0
    assert replace(NearDupConfig(), bands=2).registers == 8
