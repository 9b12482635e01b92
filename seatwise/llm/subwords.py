"""Subword-bag text classifier: hashed word and character n-gram vectors, averaged, into a softmax.

A word's vector is the mean of the vectors of its buckets (the word itself and its character n-grams); a document's
vector is the mean over its words. Vectors and output weights are learned together by stochastic gradient descent in
numpy, on a bounded sample of labelled documents. With two classes the margin of a document is the mean of the margins
of its words, so scoring keeps one number per bucket and runs in the tasks, over whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cache
from math import log
from typing import TypeVar
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seatwise.llm.text import held_out, texts_of

T = TypeVar("T")


@dataclass(frozen=True)
class SubwordConfig:
    """``max_train`` bounds the labelled documents that the model is fitted on, and so what the driver holds;
    ``max_words`` bounds the word cache of a task. Texts are scored together up to ``batch_words``, and words hashed together up
    to ``batch_chars``, or one larger text or word. With ``damped`` a word that stands n times in a text counts 1 + ln(n)
    times, and ``neutral`` words without a vector are averaged in: so one word, repeated, does not decide.
    ``false_alarms`` is the share of class 0 that may score 0.5 or more, see ``shift``; None leaves the bias as fitted."""

    buckets: int = 1 << 18
    n_grams: tuple[int, int] = (3, 5)
    dimension: int = 8
    epochs: int = 4
    learning_rate: float = 1.0
    output_rate: float = 0.001
    min_docs: int = 3
    max_train: int = 4000
    folds: int = 5
    max_words: int = 150_000
    batch_words: int = 50_000
    batch_chars: int = 500_000
    damped: bool = False
    neutral: float = 0.0
    false_alarms: float | None = None
    seed: int = 7


def buckets_of(word: str, config: SubwordConfig) -> list[int]:
    """Hash buckets of ``<word>`` and of its character n-grams."""
    marked = f"<{word}>"
    least, most = config.n_grams
    size, buckets = len(marked), config.buckets
    if marked.isascii():
        data = marked.encode()
        parts = [data[i : i + n] for n in range(least, most + 1) for i in range(size - n + 1)]
    else:
        data = marked.encode("utf-8", "surrogatepass")
        parts = [marked[i : i + n].encode("utf-8", "surrogatepass") for n in range(least, most + 1) for i in range(size - n + 1)]
    return [crc32(data) % buckets, *[crc32(p) % buckets for p in parts]]


def word_counts(words: Sequence[str], config: SubwordConfig) -> dict[str, float]:
    counts = Counter(words)
    return {w: 1 + log(n) for w, n in counts.items()} if config.damped else counts


def bag(words: Sequence[str], config: SubwordConfig) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document and their shares, which sum to 1 less that of neutral words; empty without words."""
    shares: Counter[int] = Counter()
    counts = word_counts(words, config)
    total = sum(counts.values()) + config.neutral
    for word, n in counts.items():
        ids = buckets_of(word, config)
        for i in ids:
            shares[i] += n / (total * len(ids))
    return np.fromiter(shares, np.int32, len(shares)), np.fromiter(shares.values(), np.float32, len(shares))


@dataclass(frozen=True)
class SubwordModel:
    """``margins``: of class 1 over class 0, by bucket; ``bias``: of a document without words."""

    config: SubwordConfig
    margins: np.ndarray
    bias: float

    def word_margins(self, words: Sequence[str]) -> np.ndarray:
        """Margin of each word: the mean over ``buckets_of`` it, all words at once."""
        config, margins = self.config, self.margins.astype(np.float64)
        marked = [f"<{w}>" for w in words]
        pieces = [m.encode("utf-8", "surrogatepass") for m in marked]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of characters
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        owner = np.repeat(np.arange(len(marked)), sizes)
        left = np.cumsum(sizes)[owner] - np.arange(len(owner))  # characters up to the end of the word
        whole = np.fromiter(map(crc32, pieces), np.uint32, len(pieces))
        total, found = margins[whole % np.uint32(config.buckets)], np.ones(len(marked), np.int64)
        for n in range(config.n_grams[0], config.n_grams[1] + 1):
            first = np.flatnonzero(left >= n)
            buckets = _crcs(data, starts[first], starts[first + n] - starts[first]) % np.uint32(config.buckets)
            total += np.bincount(owner[first], margins[buckets], len(marked))
            found += np.maximum(sizes - n + 1, 0)
        return total / found

    def batch_scorer(self) -> Callable[[Sequence[Sequence[str]]], list[float]]:
        """Probabilities of class 1 for lists of words, the words that are new among them hashed together."""
        config, known = self.config, {}

        def scores(documents: Sequence[Sequence[str]]) -> list[float]:
            if len(known) > config.max_words:
                known.clear()
            counted = [word_counts(words, config) for words in documents]
            new = list(dict.fromkeys(w for counts in counted for w in counts if w not in known))
            for part in cut(new, config.batch_chars, len):
                known.update(zip(part, self.word_margins(part).tolist(), strict=True))
            result = []
            for counts in counted:
                total = sum([n * known[w] for w, n in counts.items()])
                weight = sum(counts.values()) + config.neutral
                x = self.bias + (total / weight if counts else 0.0)
                result.append(float(1 / (1 + np.exp(-x))) if x > -700 else 0.0)
            return result

        return scores

    def scorer(self) -> Callable[[Sequence[str]], float]:
        """Probability of class 1 for a list of words."""
        scores = self.batch_scorer()
        return lambda words: scores([words])[0]


def cut(items: Iterable[T], most: int, size: Callable[[T], int]) -> Iterator[list[T]]:
    """Runs of items whose sizes add up to ``most`` at least, the last to less; a larger item ends its run."""
    run: list[T] = []
    held = 0
    for item in items:
        run.append(item)
        held += size(item)
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


@cache
def _crc_table(after: int) -> np.ndarray:
    """What each byte adds (by exclusive or) to the CRC-32 of a text in which ``after`` bytes follow it."""
    zero = crc32(bytes(after + 1))
    return np.array([crc32(bytes([b]) + bytes(after)) ^ zero for b in range(256)], np.uint32)


def _crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of spans of ``data``: for one length it is linear in the bytes."""
    result = np.empty(len(starts), np.uint32)
    for length in np.flatnonzero(np.bincount(lengths)).tolist():
        at = np.flatnonzero(lengths == length)
        own = starts[at]
        found = np.full(len(at), crc32(bytes(length)), np.uint32)
        for k in range(length):
            found ^= _crc_table(length - 1 - k)[data[own + k]]
        result[at] = found
    return result


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: Sequence[int], config: SubwordConfig) -> SubwordModel:
    """Bucket vectors and output weights, fitted together.

    Buckets in fewer than ``min_docs`` documents stay at zero: what they say of the sample does not carry over. They
    are taken out of ``bags``.
    """
    if not len(labels):
        return SubwordModel(config, np.zeros(config.buckets, np.float32), 0.0)
    common = documents_with(bags, config) >= config.min_docs
    for k, (ids, shares) in enumerate(bags):
        bags[k] = ids[common[ids]], shares[common[ids]]  # in place: the whole bags need not be held beside the rest
    model = descend(bags, labels, config)
    return replace(model, bias=model.bias - shift(bags, labels, config))


def documents_with(bags: Sequence[tuple[np.ndarray, np.ndarray]], config: SubwordConfig) -> np.ndarray:
    counts = np.zeros(config.buckets, np.float32)
    for ids, _ in bags:
        counts[ids] += 1
    return counts


def descend(bags: Sequence[tuple[np.ndarray, np.ndarray]], labels: Sequence[int], config: SubwordConfig) -> SubwordModel:
    """Stochastic gradient descent.

    A document's step is shared out among its buckets by their shares divided by the number of documents that have
    them, so a few telling buckets in a long text move more than its common ones.
    """
    rng = np.random.default_rng(config.seed)
    docs_with = documents_with(bags, config)
    docs_with[docs_with < config.min_docs] = np.inf  # no steps
    vectors = np.zeros((config.buckets, config.dimension), np.float32)
    output = rng.normal(0, 1, (config.dimension, 2)).astype(np.float32)
    bias, past = np.zeros(2, np.float32), np.full(2, 1e-4, np.float32)
    done, steps = 0, config.epochs * len(labels)
    for _ in range(config.epochs):
        for k in rng.permutation(len(labels)):
            rate = config.learning_rate * (1 - done / steps)
            done += 1
            ids, shares = bags[k]
            document = shares @ vectors[ids]
            logits = document @ output + bias
            slope = np.exp(logits - logits.max())
            slope /= slope.sum()
            slope[labels[k]] -= 1
            weights = shares / docs_with[ids]
            scale = rate / (weights @ shares + 1e-9)
            vectors[ids] -= (scale * weights)[:, None] * (output @ slope)
            output -= rate * config.output_rate * np.outer(document, slope)
            past += slope * slope
            bias -= 0.2 * rate * slope / np.sqrt(past)
    return SubwordModel(config, vectors @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0]))


def shift(bags: Sequence[tuple[np.ndarray, np.ndarray]], labels: Sequence[int], config: SubwordConfig) -> float:
    """What the bias goes down by, so that at most ``false_alarms`` of class 0 get a margin of 0 or more.

    Each half of the sample gets the margins of a model of the other half; copies are in the same half. The bias goes up
    no further than documents of class 1 are gained. 0 if a half lacks a class.
    """
    if config.false_alarms is None:
        return 0.0
    known = np.asarray(labels)
    half = np.array([crc32(ids.tobytes()) % 2 for ids, _ in bags])
    if len({*zip(half.tolist(), known.tolist(), strict=True)}) < 4:
        return 0.0
    margins = np.zeros(len(bags))
    for h in (0, 1):
        inside = np.flatnonzero(half != h)
        model = descend([bags[i] for i in inside], known[inside], config)
        for i in np.flatnonzero(half == h):
            ids, shares = bags[i]
            margins[i] = model.bias + shares @ model.margins[ids]
    clean = np.sort(margins[known == 0])[::-1]
    last = float(clean[int(config.false_alarms * len(clean))])
    caught = margins[(known == 1) & (margins > last)]
    lowest = float(caught.min()) if len(caught) else max(last, 0.0)
    return min(lowest, 0.0) if last < 0 else lowest


def fit(
    docs: DataFrame, labels: DataFrame, label: str, words: Callable[[str], list[str]], config: SubwordConfig
) -> SubwordModel:
    """Fit on at most ``max_train`` labelled documents outside the held-out fold, the first by a hash of their id.

    NULL labels and ids are left out, and of several labels of a document the largest counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), config.folds))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    # At most max_train rows: small enough to broadcast at any size of the input.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.max_train)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            found = [bag(words(t), config) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("label"),
                    pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([b.tobytes() for _, b in found], pa.binary()),
                ],
                ["doc_id", "label", "ids", "shares"],
            )

    read = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = read.select("doc_id", "label", "text").mapInArrow(bags, f"doc_id {id_type}, label int, ids binary, shares binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    found = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows]
    known_labels = [int(r["label"] > 0) for r in rows]
    del rows
    return train(found, known_labels, config)


def scored(docs: DataFrame, model: SubwordModel, words: Callable[[str], list[str]], name: str = "score") -> DataFrame:
    """``docs`` with the probability of class 1 of each whole text; all other columns stay. No shuffle."""
    # Bounded by the number of buckets.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = model.batch_scorer()
        for batch, texts in texts_of(batches):
            runs = cut(map(words, texts), model.config.batch_words, len)
            values = pa.array([x for run in runs for x in scores(run)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    others = docs.drop(name)
    return others.mapInArrow(run, others.select("*", F.lit(0.0).alias(name)).schema)


def predictions(docs: DataFrame, model: SubwordModel, words: Callable[[str], list[str]], threshold: float) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per document."""
    return scored(docs.select("doc_id", "text"), model, words).select(
        "doc_id",
        held_out(F.col("doc_id"), model.config.folds).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
