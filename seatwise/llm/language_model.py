"""Scores of texts by a causal self-attention model over subwords, and by the counts of words.

1. Texts that lie one after the other make a chunk of about ``chunk_bytes``, or one longer text. Tasks fold the texts of a
   chunk into its distinct words with their occurrences in training texts.
2. Occurrences are added up by word, and each distinct word is split into subwords once: the vocabulary. The
   subwords' counts come from it, so both counts cover all training texts. The most frequent subwords are symbols of
   their own; the last symbol stands for all others, which share its probability by their counts.
3. The model is trained by rounds, on symbols that are found once for all of them. In a round each bucket of training texts
   goes on from the last state on its own, step by step, and the states of all buckets are averaged in a tree. Buckets have a
   bounded size, so there are more of them when the input grows. Every training text is in one bucket of one round.
4. The vocabulary is joined to the chunks' words, and each chunk's texts meet their words: counts, subwords, windows, scores.

Windows overlap: each scores its last ``stride`` places, so a subword is scored once, with ``length - stride`` to
``length - 1`` places before it. The probability of a text is that of all its subwords and its end.

Results by case: NULL and empty texts have one token, the end; a NULL id counts as '' for the split; repeated rows count and
are scored each; without training texts N is 0 and all symbols start alike; an empty table gives an empty one. Other
columns are not read. A word goes by any text length; words are never cut.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from seatwise.llm import attention
from seatwise.llm.attention import AttentionConfig, Weights
from seatwise.workspace import delete, new_path, shuffles_dropped, stage

# No word has a line break, so it can stand for the end of a text.
END = "\n"


@dataclass(frozen=True)
class ModelConfig:
    model: AttentionConfig = field(default_factory=AttentionConfig)
    folds: int = 7
    held_fold: int = 2
    chunk_bytes: int = 32_000_000
    slice_rows: int = 1000
    cached_words: int = 200_000
    frequent_words: int = 200_000
    rounds: int = 4
    bucket_subwords: int = 400_000
    windows: int = 64  # of a training step
    rate: float = 0.01
    fan_in: int = 32


_TOGETHER = 64  # words that are coded as one text
_SLICES = 4  # slices whose words are looked up together
_SPACE = "\u0120"  # how byte-level tokenizers write a space


@lru_cache(1)
def _cuts_at_spaces(tokenizer: str) -> bool:
    """Whether the subwords of words with a space between them are those of each word, none of them empty."""
    parts = json.loads(tokenizer)
    cut = parts.get("pre_tokenizer") or {}
    letters = parts.get("model", {}).get("vocab", {})
    return (
        parts.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
        and all(t["special"] for t in parts.get("added_tokens", [])) and all(c in letters for c in ByteLevel.alphabet())
    )


class Splitter:
    """Words to subword ids; the end of a text has an id of its own, after those of the tokenizer."""

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True
        self.end = self.tokenizer.get_vocab_size()
        self.together = _TOGETHER if _cuts_at_spaces(tokenizer) else 1
        self.begins = np.zeros(self.end, bool)
        self.begins[[i for letters, i in self.tokenizer.get_vocab().items() if letters.startswith(_SPACE)]] = True

    def split(self, words: Sequence[str]) -> list[list[int]]:
        flat, sizes = self.flat(words)
        ends = np.cumsum(sizes).tolist()
        return [flat[a:b].tolist() for a, b in zip([0, *ends], ends)]

    def flat(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each word has.

        Some words are coded as one text, where each brings its own space before it and no subword goes beyond it. Words that
        hold white space beyond ASCII, which could draw that space to itself, are coded alone, with those beside them.
        """
        plain = [w for w in words if w != END]
        texts: list[str] = []
        whole: list[bool] = []
        for at in range(0, len(plain), self.together):
            some = plain[at : at + self.together]
            text = " " + " ".join(some)
            if len(some) > 1 and len(text.split()) == len(some):
                texts.append(text)
                whole.append(True)
            else:
                texts += [f" {w}" for w in some]
                whole += [False] * len(some)
        coded = [c.ids for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat, sizes = np.fromiter(chain.from_iterable(coded), np.int32), np.fromiter(map(len, coded), np.int64, len(coded))
        if any(whole):
            first = self.begins[flat] & np.repeat(whole, sizes)
            first[np.cumsum(sizes) - sizes] = True
            sizes = np.diff(np.flatnonzero(first), append=len(flat))
        if len(plain) < len(words):
            inside = np.array([w != END for w in words])
            every = np.ones(len(words), np.int64)
            every[inside] = sizes
            flat, sizes = np.insert(flat, np.cumsum(every * inside)[~inside], self.end), every
        return flat, sizes


@dataclass(frozen=True)
class Symbols:
    """Symbol of each subword id, and the logarithm of its share in the symbol; ``counts`` by symbol."""

    symbol: np.ndarray
    log_share: np.ndarray
    counts: np.ndarray

    @staticmethod
    def by_counts(counts: np.ndarray, n: int) -> Symbols:
        """The ``n - 1`` most frequent ids have a symbol each, ties by id; the last symbol is all others'."""
        order = np.lexsort((np.arange(len(counts)), -counts))
        symbol = np.full(len(counts), n - 1, np.int64)
        symbol[order[: n - 1]] = np.arange(min(n - 1, len(counts)))
        others = symbol == n - 1
        log_share = np.zeros(len(counts))
        log_share[others] = np.log((counts[others] + 1) / (counts[others].sum() + others.sum()))
        return Symbols(symbol, log_share, np.bincount(symbol, counts, minlength=n))


def chunked(docs: DataFrame, id_column: str, text_column: str, config: ModelConfig) -> DataFrame:
    """``(chunk, doc_id, held_out, text)``, staged: chunks have to be the same each time they are read."""
    doc_id, text = F.col(id_column), F.coalesce(F.col(text_column), F.lit(""))
    held = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % config.folds == config.held_fold
    rows = docs.select(F.monotonically_increasing_id().alias("chunk"), doc_id.alias("doc_id"), held.alias("held_out"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = 0, config.chunk_bytes  # a chunk has the number of its first row
        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            chunks = batch.column("chunk").to_numpy().copy()
            for i, n in enumerate(lengths.tolist()):
                if size + n > config.chunk_bytes:
                    chunk, size = int(chunks[i]), 0
                chunks[i] = chunk
                size += n
            yield pa.RecordBatch.from_arrays([pa.array(chunks), *batch.columns[1:]], batch.schema.names)

    return stage(rows.mapInArrow(run, rows.schema), "texts", codec="zstd")


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts one after the other, and how many each text has, without its end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, "")  # white space at the ends of a text leaves empty words
    owner = np.repeat(np.arange(len(texts)), lengths)[full.to_numpy(zero_copy_only=False)]
    return flat.filter(full), np.bincount(owner, minlength=len(texts))


def with_ends(words: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words with that of the end after each text, and where each text starts in them."""
    starts = np.cumsum(lengths + 1) - lengths - 1
    flat = np.full(len(words) + len(lengths), end, np.int64)
    inside = np.ones(len(flat), bool)
    inside[starts + lengths] = False
    flat[inside] = words
    return flat, starts


def spread(starts: np.ndarray, sizes: np.ndarray, words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the subwords of some words lie, one after the other, and how many each text has; ``texts``: their first words."""
    size = sizes[words]
    at = np.repeat(starts[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return at, np.add.reduceat(size, texts)


def joined(values: pa.Array) -> bytes:
    """All values one after the other, without an object for each."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), b"")[0].as_py()


def counted(words: pa.Array, n: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words with the sums of ``n``."""
    coded = words.dictionary_encode()
    sums = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(sums, coded.indices.to_numpy(), n)
    return coded.dictionary, sums


def chunk_words(texts: DataFrame, config: ModelConfig) -> DataFrame:
    """``(chunk, word, n)``: the distinct words of a chunk and their occurrences in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: int | None = None
        parts: list[tuple[pa.Array, np.ndarray]] = []

        def done() -> Iterator[pa.RecordBatch]:
            if parts:
                words, n = counted(pa.concat_arrays([w for w, _ in parts]), np.concatenate([n for _, n in parts]))
                whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(words), chunk)), words, pa.array(n)], ["chunk", "word", "n"])
                yield from (whole.slice(i, 10_000) for i in range(0, len(words), 10_000))

        for batch in batches:
            own = batch.column("chunk").to_numpy()
            cuts = np.unique([*(np.flatnonzero(np.diff(own)) + 1), *range(0, len(own), config.slice_rows), len(own)])
            for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                if own[first] != chunk:
                    yield from done()
                    chunk, parts = int(own[first]), []
                rows = batch.slice(first, end - first)
                learn = (~rows.column("held_out").to_numpy(zero_copy_only=False)).astype(np.int64)
                words, lengths = tokens(rows.column("text"))
                parts.append(counted(words, np.repeat(learn, lengths)))
                parts.append((pa.array([END]), np.array([learn.sum()])))
        yield from done()

    return texts.select("chunk", "held_out", "text").mapInArrow(run, "chunk bigint, word string, n bigint")


def vocabulary(words: DataFrame, tokenizer: str) -> DataFrame:
    """``(word, n, ids)`` of each distinct word."""
    shared = words.sparkSession.sparkContext.broadcast(tokenizer)  # bounded: a tokenizer file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(shared.value)
        for batch in batches:
            flat, sizes = splitter.flat(batch.column("word").to_pylist())
            offsets = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], ["word", "n", "ids"])

    counted = words.groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(run, "word string, n bigint, ids binary")


def subword_counts(vocabulary: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each subword id in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            packed = batch.column("ids").to_pylist()
            ids = np.frombuffer(b"".join(packed), np.int32)
            np.add.at(total, ids, np.repeat(batch.column("n").to_numpy(), [len(p) // 4 for p in packed]))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["id", "n"])

    found = vocabulary.filter("n > 0").select("n", "ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in found.collect():  # at most one row for each id of the tokenizer
        counts[row["id"]] = row["n"]
    return counts


# ---- training -------------------------------------------------------------------------------------


def packed(state: Weights) -> bytes:
    return b"".join(state[k].astype(np.float32).tobytes() for k in sorted(state))


def views(flat: np.ndarray, like: Weights) -> Weights:
    """Parts of ``flat`` in the order of their names, shaped as ``like``."""
    result, at = {}, 0
    for k in sorted(like):
        result[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return result


def unpacked(data: bytes | np.ndarray, like: Weights) -> Weights:
    flat = np.frombuffer(data, np.float32) if isinstance(data, bytes) else data.astype(np.float32)
    return {k: x.copy() for k, x in views(flat, like).items()}


def trained(state: Weights, symbols: np.ndarray, lengths: np.ndarray, turn: int, config: ModelConfig, seed: int) -> tuple[Weights, int]:
    """A pass over the windows of some texts in random order; the rate falls over all rounds. State and turns after it."""
    model = config.model
    # All weights lie in one array, all first and all second moments too: a step is few operations on long arrays.
    like = attention.weights_of(state)
    whole = {f"{kind}all": np.concatenate([state[f"{kind}{k}"].ravel() for k in sorted(like)]) for kind in ("", "m.", "v.")}
    weights = views(whole["all"], like)
    held, wanted, _ = attention.windows(symbols, lengths, model)
    order = np.random.default_rng(seed).permutation(len(held))
    held, wanted = held[order], wanted[order]
    together = np.empty_like(whole["all"])
    slopes = views(together, like)
    n = -(-len(order) // config.windows)
    for k in range(n):
        rows = slice(k * config.windows, (k + 1) * config.windows)
        attention.gradient(weights, held[rows], wanted[rows], model, slopes)
        done = (seed % config.rounds + k / n) / config.rounds
        attention.step(whole, {"all": together}, turn + k + 1, config.rate * (1 - 0.95 * done))
    return {f"{kind}{k}": x for kind in ("", "m.", "v.") for k, x in views(whole[f"{kind}all"], like).items()}, turn + n


_STATE = "part int, weight bigint, turn bigint, state binary"


def averaged(states: DataFrame, n: int, folder: str, config: ModelConfig) -> tuple[np.ndarray, int]:
    """Mean state of a round by weight, and the mean turn. ``fan_in`` states meet in a task, until few are left; what lies
    between goes below ``folder``."""

    def merge(table: pa.Table) -> pa.Table:
        weight = table.column("weight").to_numpy()
        total = sum(int(w) * np.frombuffer(s.as_py(), np.float32).astype(np.float64) for w, s in zip(weight, table.column("state"), strict=True))
        turn = int((table.column("turn").to_numpy() * weight).sum() // weight.sum())
        mean = (total / weight.sum()).astype(np.float32).tobytes()
        return pa.table({"part": pa.array(table.column("part").to_pylist()[:1], pa.int32()), "weight": [int(weight.sum())], "turn": [turn], "state": [mean]})

    while n > 4:
        n = -(-n // config.fan_in)
        states = states.withColumn("part", F.pmod("part", F.lit(n))).groupBy("part").applyInArrow(merge, _STATE)
        states = stage(states, "states", path=f"{folder}/{n}")
    rows = sorted(states.collect(), key=lambda r: r["part"])  # at most 4 states
    weight = np.array([r["weight"] for r in rows], np.float64)
    mean = sum(w * np.frombuffer(r["state"], np.float32).astype(np.float64) for w, r in zip(weight, rows, strict=True)) / weight.sum()
    return mean, int(sum(r["turn"] * r["weight"] for r in rows) // weight.sum())


def symbol_type(config: ModelConfig) -> np.dtype:
    return np.min_scalar_type(config.model.symbols - 1)


Frequent = tuple[pa.Array, pa.Array]


def frequent_words(vocabulary: DataFrame, config: ModelConfig) -> Frequent:
    """The most frequent words of the training texts and their ids: at most ``frequent_words``, and no word without all others of
    about its count or above (in steps of 2 ** (1 / 8))."""
    level = F.floor(8 * F.log2("n")).alias("level")
    sizes = vocabulary.filter("n > 0").groupBy(level).agg(F.count(F.lit(1)).alias("words")).collect()  # at most 8 levels for each bit of a count
    least, held = None, 0
    for row in sorted(sizes, reverse=True):
        held += row["words"]
        if held > config.frequent_words:
            break
        least = row["level"]
    if least is None:
        return pa.array([], pa.string()), pa.array([], pa.binary())
    found = vocabulary.filter((F.col("n") > 0) & (level >= least)).select("word", "ids").toArrow().combine_chunks()
    return tuple(pa.concat_arrays(found.column(k).chunks) for k in ("word", "ids"))


def lessons_of(texts: DataFrame, tokenizer: str, symbols: Symbols, buckets: int, config: ModelConfig, frequent: Frequent | None = None) -> DataFrame:
    """``(bucket, mark, symbols)`` of each training text: its symbols and that of its end, found once for all rounds.

    ``frequent`` words come with their ids; a task splits any other word once, as long as it holds no more than ``cached_words``.
    """
    # A tokenizer file, an entry for each of its ids, and a bounded number of words.
    shared = texts.sparkSession.sparkContext.broadcast((tokenizer, symbols, frequent or (pa.array([], pa.string()), pa.array([], pa.binary()))))
    mark = F.xxhash64(F.col("doc_id").cast("string"), "text")
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), mark), F.lit(buckets)).cast("int")
    rows = texts.filter(~F.col("held_out")).select(bucket.alias("bucket"), mark.alias("mark"), "text")
    kind = symbol_type(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of_tokenizer, known, (given, packed_ids) = shared.value
        splitter = Splitter(text_of_tokenizer)
        numbers = {w: i for i, w in enumerate(given.to_pylist())}
        sizes = pc.binary_length(packed_ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        flat = known.symbol[np.frombuffer(b"".join(packed_ids.to_pylist()), np.int32)].astype(kind)
        n_flat = len(flat)
        for batch in batches:
            for first in range(0, batch.num_rows, config.slice_rows):
                part = batch.slice(first, config.slice_rows)
                found, lengths = tokens(part.column("text"))
                coded = found.dictionary_encode()
                words = [*coded.dictionary.to_pylist(), END]
                if len(numbers) - len(given) > config.cached_words:
                    numbers, flat, sizes = dict(islice(numbers.items(), len(given))), flat[:n_flat], sizes[: len(given)]
                new = [w for w in words if w not in numbers]
                numbers.update(zip(new, range(len(numbers), len(numbers) + len(new)), strict=True))
                ids, n_ids = splitter.flat(new)
                flat = np.concatenate([flat, known.symbol[ids].astype(kind)])
                sizes = np.concatenate([sizes, n_ids])
                number = np.fromiter((numbers[w] for w in words), np.int64, len(words))
                word, starts = with_ends(coded.indices.to_numpy(), lengths, len(words) - 1)
                at, subwords = spread(np.cumsum(sizes) - sizes, sizes, number[word], starts)
                offsets = np.concatenate([[0], np.cumsum(subwords * kind.itemsize)]).astype(np.int32)
                found = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(flat[at])])
                yield pa.RecordBatch.from_arrays([part.column("bucket"), part.column("mark"), found], ["bucket", "mark", "symbols"])

    return rows.mapInArrow(run, "bucket int, mark bigint, symbols binary")


def fitted(
    texts: DataFrame, tokenizer: str, symbols: Symbols, config: ModelConfig, path: str | None = None, frequent: Frequent | None = None
) -> Weights:
    """The model after all rounds. ``path``: where the lessons lie, which nobody needs afterwards; ``frequent``: see ``lessons_of``."""
    spark = texts.sparkSession
    state = attention.with_moments(attention.initial(symbols.counts, config.model))
    total = int(symbols.counts.sum())
    parts = max(1, round(total / (config.rounds * config.bucket_subwords)))
    lessons = stage(lessons_of(texts, tokenizer, symbols, parts * config.rounds, config, frequent), "lessons", path=path, codec="zstd")
    kind = symbol_type(config)
    turn = 0
    for turn_of in range(config.rounds):
        begin = spark.sparkContext.broadcast((state, turn))  # bounded by the shape of the model

        def run(table: pa.Table) -> pa.Table:
            found, turn = begin.value
            own = {k: x.copy() for k, x in found.items()}
            bucket = table.column("bucket")[0].as_py()
            rows = [row for _, row in sorted(zip(table.column("mark").to_pylist(), table.column("symbols").to_pylist(), strict=True))]
            lengths = np.array([len(row) // kind.itemsize for row in rows])
            own, turn = trained(own, np.frombuffer(b"".join(rows), kind).astype(np.int64), lengths, turn, config, bucket)
            columns = [pa.array([bucket // config.rounds], pa.int32()), pa.array([int(lengths.sum())], pa.int64()), pa.array([turn], pa.int64()), pa.array([packed(own)], pa.binary())]
            return pa.Table.from_arrays(columns, ["part", "weight", "turn", "state"])

        # About four buckets in a task: a task is long by its steps, not by its bytes.
        here = lessons.filter(F.pmod("bucket", F.lit(config.rounds)) == turn_of).repartition(max(1, parts // 4), "bucket")
        folder = new_path(spark, "states")
        states = stage(here.groupBy("bucket").applyInArrow(run, _STATE), "states", path=f"{folder}/all")
        n = states.count()
        if n:
            mean, turn = averaged(states, n, folder, config)
            state = unpacked(mean, state)
        delete(spark, folder)  # the mean is on the driver
    return attention.weights_of(state)


# ---- scores ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scorer:
    """Texts of a chunk with the chunk's words; ``n_tokens`` is N, ``n_words`` V."""

    weights: Weights
    symbols: Symbols
    n_tokens: int
    n_words: int
    config: ModelConfig

    def __call__(self, texts: pa.Table, words: pa.Table) -> pa.Table:
        vocabulary = words.column("word").combine_chunks()
        if isinstance(vocabulary, pa.ChunkedArray):
            vocabulary = pa.concat_arrays(vocabulary.chunks)
        end = pc.index_in(pa.array([END]), value_set=vocabulary)[0].as_py()
        counts = words.column("n").to_numpy()
        logs = np.log10((counts + 1) / (self.n_tokens + self.n_words + 1))
        sizes = pc.binary_length(words.column("ids")).to_numpy().astype(np.int64) // 4
        starts, ids = np.cumsum(sizes) - sizes, np.concatenate([np.frombuffer(joined(part), np.int32) for part in words.column("ids").chunks])
        symbol, share = self.symbols.symbol.astype(symbol_type(self.config))[ids], self.symbols.log_share[ids]
        result: list[tuple[np.ndarray, ...]] = []
        for lengths, numbers in self.numbered(texts.column("text"), vocabulary):
            flat, first = with_ends(numbers, lengths, end)
            lengths += 1
            at, subwords = spread(starts, sizes, flat, first)
            score = np.add.reduceat(share[at], np.cumsum(subwords) - subwords) + self.model_scores(symbol[at].astype(np.int64), subwords)
            result.append((lengths, np.add.reduceat((counts[flat] > 0).astype(np.int64), first), np.add.reduceat(logs[flat], first), score / np.log(10)))
        columns = [np.concatenate(c) for c in zip(*result, strict=True)]
        total = pa.array(np.full(texts.num_rows, self.n_tokens), pa.int64())
        return pa.table(
            [texts.column("doc_id"), texts.column("held_out"), *map(pa.array, columns[:2]), total, *map(pa.array, columns[2:])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def numbered(self, texts: pa.ChunkedArray, vocabulary: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By slices: how many words each text has, and the numbers of the words. A look-up goes through the whole vocabulary
        first, so the distinct words of some slices are looked up together."""
        rows = self.config.slice_rows
        for start in range(0, len(texts), _SLICES * rows):
            slices: list[tuple[np.ndarray, np.ndarray]] = []
            distinct: list[pa.Array] = []
            for at in range(start, min(start + _SLICES * rows, len(texts)), rows):
                found, lengths = tokens(pa.concat_arrays(texts.slice(at, rows).chunks))
                coded = found.dictionary_encode()
                slices.append((coded.indices.to_numpy(), lengths))
                distinct.append(coded.dictionary)
            number = pc.index_in(pa.concat_arrays(distinct), value_set=vocabulary).to_numpy()
            ends = np.cumsum([len(d) for d in distinct])[:-1]
            for (own, lengths), numbers in zip(slices, np.split(number, ends), strict=True):
                yield lengths, numbers[own]

    def model_scores(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural logarithm of the model's probability of each text's symbols."""
        model, result = self.config.model, np.zeros(len(lengths))
        for start in range(0, int(attention.n_windows(lengths, model)[-1]), 4096):
            held, wanted, text = attention.windows(symbols, lengths, model, slice(start, start + 4096))
            found = attention.log_probabilities(self.weights, held, wanted, model)
            np.add.at(result, text, found.sum(axis=1))
        return result


def text_scores(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", config: ModelConfig = ModelConfig()) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row, logarithms to base 10.

    Texts outside the held-out fold are learned from; all are scored.
    """
    spark: SparkSession = docs.sparkSession
    tokenizer = Path(tokenizer_path).read_text(encoding="utf-8")
    with shuffles_dropped(spark):
        texts = chunked(docs, id_column, text_column, config)
        words = stage(chunk_words(texts, config), "chunk_words", codec="zstd")
        known = stage(vocabulary(words, tokenizer), "vocabulary", codec="zstd")
        totals = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
        symbols = Symbols.by_counts(subword_counts(known, Splitter(tokenizer).end + 1), config.model.symbols)
        lessons = new_path(spark, "lessons")
        weights = fitted(texts, tokenizer, symbols, config, lessons, frequent_words(known, config))
        delete(spark, lessons)
    shared = spark.sparkContext.broadcast(Scorer(weights, symbols, int(totals["n"]), int(totals["v"]), config))  # bounded, as above
    met = words.select("chunk", "word").join(known, "word")
    doc_id = docs.schema[id_column].dataType.simpleString()
    columns = f"doc_id {doc_id}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return shared.value(left, right)

    return texts.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(run, columns)
