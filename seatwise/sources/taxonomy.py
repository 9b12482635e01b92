"""Product taxonomy: lines ``Category: ["alias", "alias", …]``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``(alias, category)``, one row per alias. An alias listed twice keeps the first category by name."""
    line = F.col("value")
    category = F.trim(F.regexp_extract(line, r"^([^:]*):", 1))
    aliases = F.from_json(F.regexp_extract(line, r"^[^:]*:(.*)$", 1), "array<string>")
    rows = (
        spark.read.text(path)
        .filter(line.contains(":"))
        .select(category.alias("category"), F.explode(aliases).alias("alias"))
    )
    return unique_aliases(rows)


def unique_aliases(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.groupBy("alias").agg(F.min("category").alias("category"))


def write_taxonomy(taxonomy: DataFrame, path: str) -> None:
    """Write ``(alias, category)`` as taxonomy lines."""
    lines = taxonomy.groupBy("category").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    lines = lines.select(F.concat("category", F.lit(": "), F.to_json("aliases")).alias("value"))
    lines.write.mode("overwrite").text(path)
