"""Subword classifiers: held-out accuracy, misspellings, labels that must not be seen."""

import random
from dataclasses import replace
from zlib import crc32

import numpy as np
import pytest

from seatwise.llm import quality, subwords, toxicity
from tests.llm.helpers import documents, labels

SF = "/root/testdata/sf0.1"
SMALL = subwords.SubwordConfig(buckets=1 << 14, max_train=600)


def held(doc_id):
    return crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize(("module", "column", "least", "false"), [(quality, "quality", 0.98, 0.02), (toxicity, "toxic", 0.75, 0.03)])
def test_held_out_accuracy(spark, module, column, least, false):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    scores = getattr(module, f"{'quality' if module is quality else 'toxicity'}_scores")(read("documents"), read("labels"))
    rows = scores.join(read("labels"), "doc_id").filter("held_out").collect()
    assert len(rows) > 500 and all(held(r["doc_id"]) for r in rows)
    rare = 0 if module is quality else 1
    caught = [r["predicted"] == rare for r in rows if r[column] == rare]
    wrong = [r["predicted"] == rare for r in rows if r[column] != rare]
    assert sum(caught) / len(caught) >= least and sum(wrong) / len(wrong) <= false
    assert all(0 <= r["score"] <= 1 for r in rows)


def corpus(n=400):
    rng = random.Random(5)
    plain = [f"{a}{b}" for a in ("ta", "mi", "ro", "lu", "ke") for b in ("nd", "ler", "sh", "ption", "vy")]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=30)
        if i % 4 == 0:
            words[5] = words[17] = "worthless"
        rows.append((i, " ".join(words), "s"))
    return rows


def test_misspellings_and_awkward_rows(spark):
    rows = corpus()
    extra = [(1001, None, None), (1002, "", "s"), (None, "worthless worthless", "s"), (7, rows[7][1], "s"), (1003, "tand " * 20000, "s"), (1004, "you w0rthless tand ler worthles worthlesss", "s")]
    docs = documents(spark, rows + extra)
    known = labels(spark, [(i, None, int(i % 4 == 0)) for i, _, _ in rows] + [(None, 1, 1), (2, 1, None), (3, None, 0), (3, None, 0)])
    model = toxicity.fit_toxicity(docs, known, SMALL)
    got = toxicity.toxicity_scores(docs, known, SMALL).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1001]["score"] == by_id[1002]["score"]
    assert by_id[1004]["predicted"] == 1 and by_id[1003]["predicted"] == 0 and by_id[None]["predicted"] == 1
    right = [by_id[i]["predicted"] == int(i % 4 == 0) for i, _, _ in rows if held(i)]
    assert np.mean(right) > 0.95
    assert model.bias < 0
    kept = toxicity.without_toxic(docs, known, SMALL)
    assert kept.columns == docs.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert left.count(7) == 2 and 1001 in left and 1002 in left and None not in left


def test_words_of_few_documents_count():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(300)]
    rare = ["xuqqiz", "wyjjok", "vozzuy"]
    texts = [rng.choices(words, k=20) + [rare[i // 4 % 3]] * 2 * (i < 12) for i in range(1200)]
    bags = [subwords.bag(t, toxicity.CONFIG) for t in texts]
    model = subwords.train(bags, [int(i < 12) for i in range(1200)], toxicity.CONFIG)
    own = [model.margins[subwords.buckets_of(w, toxicity.CONFIG)[0]] for w in rare]
    assert min(own) > 0


def test_bias_follows_false_alarms():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(60)]
    texts = [rng.choices(words, k=15) + ["xuqqiz"] * (i % 8 == 0 and i % 3 > 0) for i in range(800)]
    known = [int(i % 8 == 0) for i in range(800)]
    for most in (0.0, 0.02, 0.2):
        config = replace(toxicity.CONFIG, false_alarms=most, epochs=4)
        score = subwords.train([subwords.bag(t, config) for t in texts[:600]], known[:600], config).scorer()
        wrong = [score(t) >= 0.5 for t, k in zip(texts[600:], known[600:], strict=True) if not k]
        assert np.mean(wrong) <= most + 0.05
        assert all(score(t) >= 0.5 for t in texts[600:] if "xuqqiz" in t)


def test_held_out_labels_do_not_matter(spark):
    rows = corpus(200)
    docs = documents(spark, rows)
    right = [(i, None, int(i % 4 == 0)) for i, _, _ in rows]
    turned = [(i, q, 1 - t if held(i) else t) for i, q, t in right]
    a = toxicity.fit_toxicity(docs, labels(spark, right), SMALL)
    b = toxicity.fit_toxicity(docs, labels(spark, turned), SMALL)
    assert np.array_equal(a.margins, b.margins) and a.bias == b.bias


def test_without_labels_or_documents(spark):
    docs, none = documents(spark, corpus(5)), labels(spark, [])
    assert {r["score"] for r in quality.quality_scores(docs, none, SMALL).collect()} == {0.5}
    assert quality.quality_scores(documents(spark, []), none, SMALL).count() == 0


@pytest.mark.parametrize("config", [quality.CONFIG, toxicity.CONFIG, SMALL])
def test_words_are_hashed_together(monkeypatch, config):
    """Margins equal a loop over each word's buckets; scoring itself hashes no word alone."""
    rng = np.random.default_rng(1)
    model = subwords.SubwordModel(config, rng.normal(0, 1, config.buckets).astype(np.float32), 0.1)
    words = ["", "a", "ab", "word", "<>", "é", "ßé", "naïve", "日本語", "𝛼𝛽x", "a😀", "\udc00", "\x00\x01", "x" * 1000, "é" * 300]
    expected = [np.mean(model.margins[subwords.buckets_of(w, config)].astype(float)) for w in words]
    assert model.word_margins(words) == pytest.approx(expected, abs=1e-12)
    monkeypatch.setattr(subwords, "buckets_of", None)
    texts = [words, ["a"] * 5, [], ["word", "日本語"] * 3]
    together, score = replace(model, config=replace(config, batch_chars=3, max_words=2)).batch_scorer(), model.scorer()
    assert together(texts) == pytest.approx([score(t) for t in texts]) == together(texts)


def test_cut():
    assert list(subwords.cut([5, 1, 9, 2, 2], 6, int)) == [[5, 1], [9], [2, 2]] and not list(subwords.cut([], 6, int))
