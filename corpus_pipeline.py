"""A corpus pipeline of five stages over the ``documents`` table, each with an operator of ``seatwise.llm``.

Toxic documents go; boilerplate lines are cut from the rest; one document of each group of near duplicates stays;
documents with benchmark passages go; what is left is encoded and decoded. Each stage sees what the one before it kept.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seatwise.llm import bpe, decontaminate, line_dedup, near_dup, toxicity
from seatwise.workspace import stage

TOKENIZER = "word_bpe_49k.json"
# Boilerplate in one language of a source of several stays below the 5 % that the SQL of op10 fixes.
LINES = line_dedup.LineConfig(ratio=0.01)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; the model is fitted on the documents given."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that too many documents of their source share; ``n_chars`` follows the text."""
    cleaned = line_dedup.drop_boilerplate(docs, "source", config=LINES)
    n_chars = F.when(F.col("lines_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return near_dup.without_near_duplicates(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any exact match of a benchmark window."""
    return decontaminate.without_contaminated(docs, _table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of each document left."""
    path = public_tokenizers.path(TOKENIZER)
    coded = bpe.decode(bpe.encode(docs, path), path)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode_and_decode),
]

# A learned model decides the first stage: SQL cannot express it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
