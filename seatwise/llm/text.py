"""Words and digests shared by the operators of this folder."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

# What separates words, after A-Z have been made lower case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_FOLD = str.maketrans(UPPER, LOWER)


def fold(text: str) -> str:
    """A-Z to a-z and nothing else; the length stays."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


def words(text: str | None) -> list[str]:
    return WORD.findall(fold(text)) if text else []


def joined_words(text: Column) -> Column:
    """The words of a text, A-Z still as they are, with one space between them; '' for NULL."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " "))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose crc32 of the id as text is divisible by ``folds``; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def texts_of(
    batches: Iterable[pa.RecordBatch], column: str = "text", rows: int = 500
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches of at most ``rows`` rows with their texts, so that few texts are Python strings at a time; NULL is the
    empty text. An empty batch stays."""
    for batch in batches:
        for first in range(0, max(1, batch.num_rows), rows):
            part = batch.slice(first, rows)
            yield part, [t or "" for t in part.column(column).to_pylist()]
        pa.default_memory_pool().release_unused()
