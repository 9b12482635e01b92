"""Small inputs with all the awkward cases, and plain-loop counterparts of shared steps."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text: str | None) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Columns whose names the operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, spans int, key int, row int, chunk int, term int, class int, kept int"


def documents(spark: SparkSession, rows: list[tuple], partitions: int = 3) -> DataFrame:
    """``(doc_id, text, source)`` rows as documents with clashing extra columns."""
    full = [(i, t, None, s, None if t is None else len(t), "x", 1, 2, 3, 4, 5, 6, 7) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions) if full else spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
