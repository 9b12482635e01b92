"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seatwise.llm import (
    bpe, decontaminate, divergence, language_model, licenses, line_dedup, near_dup, negatives, neighbours, pii, quality, secrets, toxicity,
)
from seatwise.llm.text import digest, span_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def _based(spans: Column, kinds: tuple[str, ...]) -> Column:
    return digest(span_text(F.filter(spans, lambda s: s["kind"].isin(*kinds)))).alias("base_sha256")


@query
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return secrets.secret_spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[_counted(spans, kind) for kind in secrets.BASE_KINDS],
        _based(spans, secrets.BASE_KINDS),
        span_text(spans).alias("spans"),
    )


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(licenses.license_detections(table(spark, sf_dir, "documents")))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return pii.pii_spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[_counted(spans, kind) for kind in pii.BASE_KINDS],
        _based(spans, pii.BASE_KINDS),
        span_text(spans).alias("spans"),
        # In the order of the spans.
        F.transform(spans, lambda s: F.round(s["score"], 4)).alias("scores"),
    )


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(table(spark, sf_dir, "documents"), path)
    return bpe.decode(coded, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda total, run: total + run["end"] - run["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        digest(F.array_join(F.array_sort("items"), ",")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(documents, "source").drop("source")


ORACLES["op10_line_dedup"] = line_dedup.LINES_SQL


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))
ORACLES["op7_decontamination"] = decontaminate.CONTAMINATION_SQL


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    other = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", other), F.col("vec_id") % 50 == 0)


ORACLES["op11_hard_negatives"] = negatives.NEGATIVES_SQL


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = divergence.DIVERGENCE_SQL


@query
def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.text_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
