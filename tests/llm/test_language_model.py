"""The attention model against finite differences and a plain loop; scores against a plain count of words."""

import math
import re
from collections import Counter
from pathlib import Path
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seatwise.llm import attention, language_model
from seatwise.llm.attention import AttentionConfig
from seatwise.llm.language_model import END, ModelConfig, Scorer, Splitter, Symbols, text_scores
from seatwise.workspace import stage
from tests.llm.helpers import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
TINY = AttentionConfig(classes=3, width=4, dimension=5, hidden=6, length=7, stride=4)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokenizer_text():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def weights(seed=0):
    rng = np.random.default_rng(seed)
    w = attention.initial(rng.integers(0, 50, TINY.symbols).astype(float), TINY)
    return {k: (x + rng.normal(0, 0.2, x.shape)).astype(np.float64) for k, x in w.items()}


def plain_log(w, symbols):
    """Log probability of each symbol by loops, with the context that the windows give."""
    result = []
    for t, wanted in enumerate(symbols):
        stride, length = TINY.stride, TINY.length
        start = t // stride * stride + stride - length  # first place of t's window
        places = [p for p in range(start, t + 1) if p >= 0]
        h = [w["embedding"][TINY.symbols if p == 0 else symbols[p - 1]] + w["place"][p - start] for p in places]
        q = h[-1] @ w["query"]
        a = np.array([q @ (x @ w["key"]) / math.sqrt(TINY.dimension) for x in h])
        a = np.exp(a) / np.exp(a).sum()
        h1 = h[-1] + sum(ai * (x @ w["value"]) for ai, x in zip(a, h)) @ w["out"]
        h2 = h1 + np.maximum(h1 @ w["up"] + w["up_bias"], 0) @ w["down"]
        kind, member = divmod(int(wanted), TINY.width)
        one, two = h2 @ w["class"] + w["class_bias"], h2 @ w["member"][kind] + w["member_bias"][kind]
        result.append(one[kind] - np.log(np.exp(one).sum()) + two[member] - np.log(np.exp(two).sum()))
    return result


@pytest.mark.parametrize("part", [slice(None), slice(1, 3)])
def test_windows_score_each_place_once_as_loops_do(part):
    w, rng = weights(), np.random.default_rng(1)
    lengths = np.array([1, 3, 4, 5, 20, 9])
    texts = [rng.integers(0, TINY.symbols, n) for n in lengths]
    held, wanted, text = attention.windows(np.concatenate(texts), lengths, TINY)
    found = attention.log_probabilities(w, held, wanted, TINY)
    for i, symbols in enumerate(texts):
        assert (wanted[text == i] >= 0).sum() == len(symbols)
        assert found[text == i][wanted[text == i] >= 0] == pytest.approx(plain_log(w, symbols), abs=1e-5)
    some = attention.windows(np.concatenate(texts), lengths, TINY, part)
    assert all(np.array_equal(a[part], b) for a, b in zip((held, wanted, text), some))


def test_probabilities_sum_to_one():
    w = weights(2)
    context = [3, 1, 4, 1, 5]
    total = sum(math.exp(plain_log(w, [*context, s])[-1]) for s in range(TINY.symbols))
    assert total == pytest.approx(1)


def test_gradient_equals_finite_differences():
    w, rng = weights(3), np.random.default_rng(4)
    lengths = np.array([2, 9, 13])
    held, wanted, _ = attention.windows(rng.integers(0, TINY.symbols, lengths.sum()), lengths, TINY)
    loss, g = attention.gradient(w, held, wanted, TINY)
    assert loss == pytest.approx(-attention.log_probabilities(w, held, wanted, TINY).sum() / lengths.sum(), rel=1e-6)
    for name, x in w.items():
        for at in [np.unravel_index(i, x.shape) for i in rng.integers(0, x.size, 6)]:
            kept = x[at]
            x[at] = kept + 1e-5
            more = attention.gradient(w, held, wanted, TINY)[0]
            x[at] = kept - 1e-5
            less = attention.gradient(w, held, wanted, TINY)[0]
            x[at] = kept
            assert g[name][at] == pytest.approx((more - less) / 2e-5, abs=2e-5), name


def test_symbols_keep_all_probability():
    counts = np.array([5, 0, 9, 1, 9, 0, 2])
    symbols = Symbols.by_counts(counts, 4)
    assert symbols.symbol.tolist() == [2, 3, 0, 3, 1, 3, 3] and symbols.counts.tolist() == [9, 9, 5, 3]
    assert np.exp(symbols.log_share[symbols.symbol == 3]).sum() == pytest.approx(1)
    assert not symbols.log_share[symbols.symbol < 3].any()


def test_splitter():
    splitter = Splitter(tokenizer_text())
    ids = splitter.split(["word", END, "<|endoftext|>", "été"])
    assert ids[1] == [splitter.end] and splitter.end not in ids[2] and 50256 not in ids[2]
    assert splitter.tokenizer.decode(ids[0] + ids[3]) == " word été"


def plain(rows):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    texts = [(i, [*WORD.findall((t or "").translate(fold)), None]) for i, t, _ in rows]
    held = [crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in texts]
    counts = Counter(w for (_, words), h in zip(texts, held) if not h for w in words)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (i is None, i or 0, h, len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 8))
        for (i, words), h in zip(texts, held)
    )


def base(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in df.collect())


SMALL = ModelConfig(chunk_bytes=200, bucket_subwords=300, rounds=2, fan_in=2, slice_rows=3)


def test_counts_equal_a_plain_loop(spark):
    """Several chunks, long texts of their own, NULLs, repeated rows and clashing columns."""
    rows = [(i, f"the Quick word{i % 5} runs\tand\x0brests x{i}", "s") for i in range(40)]
    rows += [(40, None, "s"), (41, "", "s"), (None, "the the THE", "s"), (42, "long words " * 200, "s"), (43, "a" * 5000, "s"), (43, "a" * 5000, "s"), (44, "é\x85ß   𝛼", "s")]
    scored = text_scores(documents(spark, rows), PATH, config=SMALL).cache()
    assert base(scored) == plain(rows)
    assert scored.filter("score >= 0 or score is null or isnan(score)").count() == 0
    empty = [r.score for r in scored.filter("n_tokens = 1").collect()]
    assert empty == pytest.approx([empty[0]] * len(empty), rel=1e-5)


def test_empty_tables_and_no_training_texts(spark):
    assert text_scores(documents(spark, []), PATH, config=SMALL).collect() == []
    held = [i for i in range(100) if crc32(str(i).encode()) % 7 == 2][:3]
    rows = [(i, "some text", "s") for i in held]
    assert base(text_scores(documents(spark, rows), PATH, config=SMALL)) == plain(rows)


def test_scores_follow_the_model(spark):
    """A text's score is the sum over its own subwords, whatever else is in its chunk."""
    import pyarrow as pa

    splitter = Splitter(tokenizer_text())
    texts = ["some words here", "other words " * 30, ""]
    words = sorted({w for t in texts for w in t.split()}) + [END]
    ids = splitter.split(words)
    symbols = Symbols.by_counts(np.bincount([i for w in ids for i in w], minlength=splitter.end + 1), TINY.symbols)
    config = ModelConfig(model=TINY, slice_rows=2)
    w = {k: x.astype(np.float32) for k, x in weights().items()}
    table = pa.table({"word": words, "n": [1] * len(words), "ids": [np.array(i, np.int32).tobytes() for i in ids]})
    rows = pa.table({"doc_id": [1, 2, 3], "held_out": [False] * 3, "text": texts})
    result = Scorer(w, symbols, 10, 5, config)(rows, table).to_pylist()
    for r, text in zip(result, texts):
        own = [i for word in [*text.split(), END] for i in splitter.split([word])[0]]
        expected = (sum(plain_log(w, symbols.symbol[own])) + symbols.log_share[own].sum()) / math.log(10)
        assert r["score"] == pytest.approx(expected, rel=1e-4)


def test_all_training_texts_are_lessons(spark):
    """However many subwords there are, every text outside the held-out fold is trained on, once."""
    rows = [(i, f"text {i} of many") for i in range(60)]
    texts = language_model.chunked(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", ModelConfig())
    seen = {}

    def watched(df, name, **options):
        seen[name] = stage(df, name, **options)
        return seen[name]

    counts = np.full(AttentionConfig().symbols, 50_000.0)
    known = Symbols(np.zeros(Splitter(tokenizer_text()).end + 1, np.int64), np.zeros(Splitter(tokenizer_text()).end + 1), counts)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_model, "stage", watched)
        language_model.fitted(texts, tokenizer_text(), known, ModelConfig(rounds=1))
    assert seen["lessons"].count() == texts.filter("not held_out").count() > 40


def test_training_beats_the_counts(spark):
    """On text with a pattern the trained model says more than the counts of words, also on held-out texts."""
    rows = [(i, " ".join(["red blue green blue", "one two three two"][(i + k) % 2] for k in range(30)), "s") for i in range(400)]
    config = ModelConfig(bucket_subwords=20_000, rounds=2, windows=8)
    row = text_scores(documents(spark, rows), PATH, config=config).filter("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert row.score > 0.5 * row.base


def test_lessons_hold_the_symbols_of_their_texts(spark, monkeypatch):
    """Texts are split once for all rounds, also when the words of a task are more than it keeps; nothing is left behind."""
    rows = [(i, t) for i, t in enumerate(["Some words here", " other\twords words ", "", None, "a" * 50, "été ß"] * 8)]
    config = ModelConfig(model=TINY, slice_rows=3, cached_words=4)
    texts = language_model.chunked(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", config)
    splitter = Splitter(tokenizer_text())
    rng = np.random.default_rng(0)
    known = Symbols(rng.integers(0, TINY.symbols, splitter.end + 1), np.zeros(splitter.end + 1), np.ones(TINY.symbols))
    found = language_model.lessons_of(texts, tokenizer_text(), known, 5, config).collect()
    kind = language_model.symbol_type(config)
    expected = []
    for text in [r.text for r in texts.filter("not held_out").collect()]:
        ids = splitter.split([*WORD.findall(text.lower()), END])
        expected.append(known.symbol[[i for w in ids for i in w]].tolist())
    assert sorted(np.frombuffer(r.symbols, kind).tolist() for r in found) == sorted(expected)
    assert len({r.bucket for r in found}) > 1 and all(0 <= r.bucket < 5 for r in found)


def test_steps_on_one_array_equal_steps_by_name():
    config = ModelConfig(model=TINY, windows=2)
    lengths = np.array([30, 1, 47])
    symbols = np.random.default_rng(3).integers(0, TINY.symbols, lengths.sum())
    start = attention.with_moments({k: x.astype(np.float32) for k, x in weights().items()})
    got, turn = language_model.trained({k: x.copy() for k, x in start.items()}, symbols, lengths, 4, config, 1)
    held, wanted, _ = attention.windows(symbols, lengths, TINY)
    order = np.random.default_rng(1).permutation(len(held))
    for k in range(turn - 4):
        rows = order[2 * k : 2 * k + 2]
        slope = attention.gradient(attention.weights_of(start), held[rows], wanted[rows], TINY)[1]
        attention.step(start, slope, 4 + k + 1, config.rate * (1 - 0.95 * (1 + k / (turn - 4)) / config.rounds))
    assert turn - 4 == -(-len(held) // 2) and got.keys() == start.keys()
    for k in start:
        assert np.allclose(got[k], start[k], rtol=1e-5, atol=1e-7), k


def test_frequent_words_are_not_split_again(spark):
    """The most frequent words come to the lessons with their ids, which give the same symbols, and are bounded in number."""
    rows = [(i, " ".join(["often"] * 9 + ["twice"] * 2 + [f"x{i}y"])) for i in range(40)]
    config = ModelConfig(model=TINY, slice_rows=3, cached_words=4, frequent_words=4)
    texts = language_model.chunked(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", config)
    known = language_model.vocabulary(language_model.chunk_words(texts, config), tokenizer_text())
    frequent = language_model.frequent_words(known, config)
    assert sorted(frequent[0].to_pylist()) == sorted(["often", "twice", END])
    splitter = Splitter(tokenizer_text())
    assert [np.frombuffer(ids, np.int32).tolist() for ids in frequent[1].to_pylist()] == splitter.split(frequent[0].to_pylist())
    assert language_model.frequent_words(known, ModelConfig(frequent_words=0))[0].to_pylist() == []
    symbols = Symbols(np.random.default_rng(0).integers(0, TINY.symbols, splitter.end + 1), np.zeros(splitter.end + 1), np.ones(TINY.symbols))
    plainly, given = ({(r.bucket, r.mark, bytes(r.symbols)) for r in language_model.lessons_of(texts, tokenizer_text(), symbols, 5, config, f).collect()} for f in (None, frequent))
    assert plainly == given and len(given) > 20
    # Other ids for a frequent word reach the lessons: it was not split there.
    other = frequent[0], pa.array([np.array([7], np.int32).tobytes()] * len(frequent[0]), pa.binary())
    changed = {bytes(r.symbols) for r in language_model.lessons_of(texts, tokenizer_text(), symbols, 5, config, other).collect()}
    assert changed.isdisjoint({s for _, _, s in given})


def test_stages_of_training_go_with_it(spark):
    """What only the training needs is gone when it ends, and the setting for shuffle files is as it was."""
    left, kept = {}, []

    def watched(df, name, path=None, **options):
        result = stage(df, name, path, **options)
        kept.append((name, result.inputFiles()))
        return result

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_model, "stage", watched)
        text_scores(documents(spark, [(i, f"text {i}", "s") for i in range(30)]), PATH, config=SMALL).collect()
    for kind, files in kept:
        left[kind] = left.get(kind, 0) + sum(Path("/" + f.removeprefix("file:").lstrip("/")).exists() for f in files)
    assert left["lessons"] == left["states"] == 0 < min(left["texts"], left["vocabulary"])
    assert spark.conf.get(name) == before


def test_words_are_coded_together_as_alone():
    """Also words with white space beyond ASCII, which a text of several words would cut elsewhere; few texts are coded."""
    splitter = Splitter(tokenizer_text())
    odd = [END, "a\u00a0", "b", "\u3000x", "\u0085", "''s", "'s", "!!", "<|endoftext|>", "\x1cx", "\u0120x", "\u200b", "1", "\u00b2", "\u00e9", END, END]
    words = odd + [f"w{i}, it's" if i % 50 else END for i in range(300)] + [chr(c) * 3 for c in range(33, 1000)] + odd
    words = [part for w in words for part in (w.split(" ") if w != END else [w])]

    class Watched:
        texts = 0

        def encode_batch_fast(self, texts, **options):
            Watched.texts += len(texts)
            return Splitter(tokenizer_text()).tokenizer.encode_batch_fast(texts, **options)

    expected = [[splitter.end] if w == END else splitter.tokenizer.encode(f" {w}", add_special_tokens=False).ids for w in words]
    splitter.tokenizer = Watched()
    flat, sizes = splitter.flat(words)
    assert sizes.tolist() == [len(i) for i in expected] and flat.tolist() == [i for ids in expected for i in ids]
    assert splitter.split(words) == expected and Watched.texts < len(words)
    assert splitter.split([]) == [] and splitter.split([END]) == [[splitter.end]]
    # Where a space doesn't cut, words are coded alone.
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        assert splitter.together > 1 == Splitter(f.read()).together


def test_gradient_fills_the_arrays_it_is_given():
    """A step's gradient takes no new arrays, and nothing of the step before stays in them."""
    w, rng = weights(6), np.random.default_rng(7)
    held, wanted, _ = attention.windows(rng.integers(0, 4, 9), np.array([2, 7]), TINY)
    loss, plain = attention.gradient(w, held, wanted, TINY)
    into = {name: np.full_like(x, np.nan) for name, x in w.items()}
    again, given = attention.gradient(w, held, wanted, TINY, into)
    assert again == loss and all(given[name] is into[name] and np.array_equal(into[name], plain[name]) for name in w)


def test_words_of_slices_are_looked_up_together(monkeypatch):
    """A chunk's vocabulary is not gone through for each of its slices: here once for four, once for one and once for the end."""
    splitter, calls = Splitter(tokenizer_text()), []
    texts = [f"word{i} again" for i in range(9)]
    words = sorted({w for t in texts for w in t.split()}) + [END]
    table = pa.table({"word": words, "n": [1] * len(words), "ids": [np.array(i, np.int32).tobytes() for i in splitter.split(words)]})
    rows = pa.table({"doc_id": list(range(9)), "held_out": [False] * 9, "text": texts})
    symbols = Symbols(np.zeros(splitter.end + 1, np.int64), np.zeros(splitter.end + 1), np.ones(TINY.symbols))
    found = language_model.pc.index_in
    monkeypatch.setattr(language_model.pc, "index_in", lambda *a, **k: (calls.append(1), found(*a, **k))[1])
    result = Scorer(weights(), symbols, 10, 5, ModelConfig(model=TINY, slice_rows=2))(rows, table).to_pylist()
    assert len(calls) == 3 and [r["n_tokens"] for r in result] == [3] * 9 == [r["n_known"] for r in result]
