"""BPE encoding and decoding through a table of distinct words.

1. Tasks split texts into words and write them in chunks: a chunk has the dictionary of its words and, for each
   document, the places of its words in it. A chunk holds a bounded number of words (or one longer document).
2. The dictionary entries of all chunks are dealt and sorted by word: equal words stand together, and each distinct word
   is encoded once.
3. The ids go back to their chunks, which have been written in buckets and need no shuffle, and there to the places of
   the documents.
4. Decoding joins ids with the vocabulary's id-to-piece table, which is of a fixed size.

Only distinct words per chunk are shuffled, so a frequent word costs a row per chunk. Results by case: NULL and
empty texts have no ids and decode to ''; copies of a row each give a row; an empty table gives an empty one. Only the
id and text columns are read; ids may be NULL or repeat.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from seatwise.llm.text import texts_of
from seatwise.workspace import new_path

CHUNK_WORDS = 5_000_000
GROUP_WORDS = 200_000
# What Spark allows by default.
MAX_BUCKETS = 100_000
# Texts of these characters are normalised by lower-casing alone: no combining marks, no special spaces, no dotted I.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ňŊ-ſ]*")
# The letters and numbers among them.
_LETTERS, _NUMBERS = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9²³¹¼½¾"


class Splitter:
    """The words of a text as the tokenizer file defines them: special tokens, normalizer, splitting expression."""

    def __init__(self, definition: str) -> None:
        parsed = json.loads(definition)
        pattern = next(p for p in parsed["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        specials = [t["content"] for t in parsed["added_tokens"]]
        self.specials = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.find = re.compile(pattern.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _NUMBERS)).findall
        self.normalizer = Tokenizer.from_str(definition).normalizer
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)

    def words(self, text: str) -> list[str]:
        if self.specials and "<|" in text:
            parts = self.specials.split(text)
            return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self._ordinary(part))]
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[str]:
        if not text:
            return []
        if _PLAIN.fullmatch(text):
            return self.find(text.lower())
        return [piece for piece, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]


class WordEncoder:
    """Ids of one word at a time, special tokens included."""

    def __init__(self, definition: str) -> None:
        tokenizer = Tokenizer.from_str(definition)
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.model = tokenizer.model
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for piece, _ in self.to_bytes.pre_tokenize_str(word) for t in self.model.tokenize(piece)]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, compressed: the four bytes of all numbers apart, since the upper ones are mostly 0."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 6)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def split_documents(docs: DataFrame, definition: str, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Chunks of documents: a row with the chunk's ``words``, and rows of some documents with their ids, numbers of words
    and the ``places`` of those words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(shared.value)
        chunk = TaskContext.get().partitionId() << 12
        dictionary: dict[str, int] = {}
        ids, sizes, found = [], [], []
        held = 0
        kind = None

        def row(words=None, doc_ids=None, counts=None, places=None) -> pa.RecordBatch:
            values = [(chunk, pa.int64()), (doc_ids, pa.list_(kind)), (counts, pa.list_(pa.int32())), (words, pa.list_(pa.string())), (places, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["chunk", "doc_ids", "sizes", "words", "places"])

        for batch, texts in texts_of(batches):
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                words = splitter.words(text)
                full = held and held + len(words) > chunk_words
                if ids and (full or len(found) + len(words) > GROUP_WORDS):
                    yield row(doc_ids=ids, counts=sizes, places=packed(np.array(found, np.uint32)))
                    ids, sizes, found = [], [], []
                if full:
                    yield row(words=list(dictionary))
                    dictionary, held, chunk = {}, 0, chunk + 1
                held += len(words)
                ids.append(doc_id)
                sizes.append(len(words))
                found += [dictionary.setdefault(w, len(dictionary)) for w in words]
        if ids:
            yield row(doc_ids=ids, counts=sizes, places=packed(np.array(found, np.uint32)))
        if dictionary:
            yield row(words=list(dictionary))

    return docs.mapInArrow(run, f"chunk bigint, doc_ids array<{id_type}>, sizes array<int>, words array<string>, places binary")


# A chunk's number and a place in its dictionary are one long: this many bits are the place.
SLOT_BITS = 28


def id_type(definition: str) -> str:
    """The smallest number type for the ids of the vocabulary."""
    return "<u2" if Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def encoded_entries(entries: DataFrame, definition: str) -> DataFrame:
    """``(chunk, slot_ids)`` for ``(entry, word)``: dealt and sorted by word, each distinct word is encoded once.

    ``slot_ids`` are the place in the chunk's dictionary, in 4 bytes, and the ids, in ``id_type`` each.
    """
    kind = id_type(definition)
    shared = entries.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(shared.value)
        last, data = None, b""
        for batch in batches:
            entry = batch.column("entry").to_numpy()
            slots = (entry & ((1 << SLOT_BITS) - 1)).astype("<i4").tobytes()
            found = []
            for i, word in enumerate(batch.column("word").to_pylist()):
                if word != last:
                    last, data = word, np.array(encoder.ids(word), kind).tobytes()
                found.append(slots[4 * i : 4 * i + 4] + data)
            yield pa.RecordBatch.from_arrays([pa.array(entry >> SLOT_BITS), pa.array(found, pa.binary())], ["chunk", "slot_ids"])

    dealt = entries.repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "chunk bigint, slot_ids binary")


def assembler(id_kind: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def assemble(coded: pa.Table, table: pa.Table) -> pa.Table:
        try:
            return assembled(coded, table, id_kind)
        finally:
            pa.default_memory_pool().release_unused()

    return assemble


def assembled(coded: pa.Table, table: pa.Table, id_kind: str) -> pa.Table:
    """One chunk: the ids of its words to the places of its documents."""
    width = np.dtype(id_kind).itemsize
    data = table.column("slot_ids").combine_chunks()
    lengths = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64) // width
    raw = b"".join(data.to_pylist())
    flat = np.frombuffer(raw, id_kind)
    at = np.cumsum(lengths) - lengths
    # By place in the dictionary: where the word's ids start, and how many there are.
    starts, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    slots = flat[at].astype(np.int64)
    if width == 2:
        slots += flat[at + 1].astype(np.int64) << 16
    starts[slots], sizes[slots] = at + 4 // width, lengths - 4 // width
    kind = coded.schema.field("doc_ids").type.value_type
    ids, parts, counts = [], [], []
    for row in coded.select(["doc_ids", "sizes", "places"]).to_pylist():
        places = unpacked(row["places"])
        n = sizes[places]
        # The ids of word after word: each word's start, then one further at a time.
        ends = np.cumsum(n)
        steps = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[places] - (ends - n), n)
        parts.append(flat[steps].astype(np.int32))
        until = np.concatenate([[0], ends])[np.cumsum(row["sizes"])]
        counts += np.diff(until, prepend=0).tolist()
        ids += row["doc_ids"]
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    return pa.Table.from_arrays([pa.array(ids, kind), lists], names=["doc_id", "ids"])


def encode(
    docs: DataFrame, tokenizer_file: str, id_column: str = "doc_id", text_column: str = "text", chunk_words: int = CHUNK_WORDS
) -> DataFrame:
    """``(doc_id, ids)``: the ids of each whole text."""
    spark = docs.sparkSession
    definition = Path(tokenizer_file).read_text(encoding="utf-8")
    read = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    name = f"words_{uuid4().hex}"
    buckets = min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    split_documents(read, definition, chunk_words).write.bucketBy(buckets, "chunk").option("compression", "zstd").option(
        "path", new_path(spark, "words")
    ).saveAsTable(name)

    dictionaries = spark.table(name).filter(F.col("words").isNotNull()).select("chunk", F.posexplode("words").alias("slot", "word"))
    entries = dictionaries.select(F.shiftleft("chunk", SLOT_BITS).bitwiseOR(F.col("slot").cast("bigint")).alias("entry"), "word")
    places = spark.table(name).filter(F.col("places").isNotNull()).select("chunk", "doc_ids", "sizes", "places")
    sent = encoded_entries(entries, definition)
    doc_type = read.schema["doc_id"].dataType.simpleString()
    return places.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(assembler(id_type(definition)), f"doc_id {doc_type}, ids array<int>")


def decode(coded: DataFrame, tokenizer_file: str, ids_column: str = "ids", name: str = "decoded") -> DataFrame:
    """``coded`` with the decoded text: each id joined with its piece, pieces joined by a space. NULL ids decode to ''.

    The id-to-piece table is the tokenizer's vocabulary, of a fixed size, and so is sent to all tasks. An id that is not
    in it is left out.
    """
    pieces = Tokenizer.from_file(tokenizer_file).get_vocab(with_added_tokens=True)
    by_id: list[str | None] = [None] * (max(pieces.values()) + 1)
    for piece, i in pieces.items():
        by_id[i] = piece
    shared = coded.sparkSession.sparkContext.broadcast(by_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.large_string())
        for batch in batches:
            for part in _parts(batch, ids_column):
                ids = pc.fill_null(part.column(ids_column), pa.scalar([], part.schema.field(ids_column).type))
                flat = ids.flatten()
                known = pc.and_(pc.less(flat, len(table)), pc.greater_equal(flat, 0))
                found = table.take(pc.if_else(known, flat, None))
                lists = pa.LargeListArray.from_arrays(pc.cast(pc.subtract(ids.offsets, ids.offsets[0]), pa.int64()), found)
                text = pc.binary_join(lists, pa.scalar(" ", pa.large_string())) if not found.null_count else _joined(lists)
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.string())], [*part.schema.names, name])
            pa.default_memory_pool().release_unused()

    others = coded.drop(name)
    return others.mapInArrow(run, others.select("*", F.lit("").alias(name)).schema)


def _parts(batch: pa.RecordBatch, column: str, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with at most ``most`` ids at a time (or one longer row)."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, n = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and n + size > most:
            yield batch.slice(first, i - first)
            first, n = i, 0
        n += size
    if len(sizes):
        yield batch.slice(first)


def _joined(lists: pa.LargeListArray) -> pa.Array:
    return pa.array([" ".join(p for p in row if p is not None) for row in lists.to_pylist()], pa.large_string())
