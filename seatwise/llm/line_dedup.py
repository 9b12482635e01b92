"""Line dedup by site-relative frequency, in DataFrame expressions only.

Pages are grouped by host. The share of a line is the number of pages of the host that contain it, divided by all pages
of the host; lines above the boilerplate ratio, on at least ``min_pages`` pages, are dropped from that host's pages.
Lines compare by a digest of 128 bits; blank lines are never dropped.

Counts are summed in the tasks before the shuffle, so a host or a line with a third of all rows is a few rows per task.
A host has at most (mean lines per page) / ratio lines above the ratio, so a row can carry its host's set.

Results by case: a NULL text stays NULL and counts as a page without lines; '' stays ''; a NULL host is a host of its own;
copies of a page are pages of their own; an empty table gives an empty one. All columns stay; ``lines_dropped`` is
added, in place of an input column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seatwise.operators.skew import skew_join
from seatwise.workspace import stage

# Sets of lines with at most this many lines in all (32 bytes each) are broadcast.
MAX_BROADCAST_LINES = 1_000_000


@dataclass(frozen=True)
class LineConfig:
    ratio: float = 0.05
    min_pages: int = 5


def _line_key(line: Column) -> Column:
    """One atomic value: Spark takes distinct and common elements of these by hashing, of structs by comparing all pairs."""
    return F.md5(line)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, host: str, text: str, config: LineConfig = LineConfig()) -> DataFrame:
    """``(_host, _set)``: the hashes of each host's boilerplate lines; hosts without any have no row.

    Hosts are compared as ``_host``, an array of the host, since NULL equals NULL inside an array.
    """
    read = pages.select(F.array(F.col(host)).alias("_host"), F.col(text).alias("_text"))
    totals = read.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    full = F.filter(_lines(F.col("_text")), lambda line: F.trim(line) != "")
    counts = (
        read.select("_host", F.explode(F.array_distinct(F.transform(full, _line_key))).alias("_key"))
        .groupBy("_host", "_key")
        .agg(F.count(F.lit(1)).alias("_with"))
        .filter(F.col("_with") >= config.min_pages)
    )
    above = counts.join(totals, "_host").filter(F.col("_with") > F.col("_pages") * F.lit(config.ratio))
    return above.groupBy("_host").agg(F.collect_list("_key").alias("_set"))


def drop_boilerplate(pages: DataFrame, host: str, text: str = "text", config: LineConfig = LineConfig()) -> DataFrame:
    """All pages, ``text`` without its host's boilerplate lines, and ``lines_dropped``."""
    sets = stage(boilerplate(pages, host, text, config), "boilerplate")
    held = sets.agg(F.coalesce(F.sum(F.size("_set")), F.lit(0))).first()[0]
    # The row is one column meanwhile, so that its columns clash with none of these.
    lines = _lines(F.col(text))
    keyed = pages.select(F.struct("*").alias("row"), F.array(F.col(host)).alias("_host"), F.col(text).alias("text"), lines.alias("lines"))
    if held <= MAX_BROADCAST_LINES:
        joined = keyed.join(F.broadcast(sets), "_host", "left")
    else:
        joined = skew_join(keyed, sets, ["_host"], spread=["text"], how="left")
    # Of the host's set, which may be long, only what this page has: few lines, which each line is held against.
    hits = F.array_intersect(F.transform(F.filter("lines", lambda line: F.trim(line) != ""), _line_key), F.col("_set"))
    marked = joined.select("row", "text", "lines", F.when(F.col("_set").isNotNull() & F.col("text").isNotNull(), hits).alias("hits"))
    left = F.filter("lines", lambda line: (F.trim(line) == "") | ~F.array_contains(F.col("hits"), _line_key(line)))
    kept = marked.select("row", "text", "lines", F.when(F.size("hits") > 0, left).alias("kept"))
    dropped = F.when(F.col("kept").isNotNull(), F.size("lines") - F.size("kept")).otherwise(0).cast("bigint")
    changed = kept.select("row", "text", "kept", dropped.alias("dropped"))
    cleaned = F.when(F.col("dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("text"))
    return changed.select(F.col("row").withField(f"`{text}`", cleaned).alias("row"), "dropped").select("row.*", "dropped").transform(
        lambda df: _renamed_last(df, pages.columns, "lines_dropped")
    )


def _renamed_last(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``df``, whose last column gets ``name``; an input column of that name goes."""
    named = df.toDF(*[f"c{i}" for i in range(len(columns))], "last")
    return named.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c.lower() != name], F.col("last").alias(name))


# The same over the documents table; fixed values stand in for LineConfig's defaults.
LINES_SQL = """
with pages as (select source, count(*) as n from documents group by source),
split as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
counts as (
  select source, line, count(*) as n from (select source, unnest(list_distinct(lines)) as line from split)
  where trim(line) <> '' group by source, line),
above as (
  select c.source, list(c.line) as found from counts c join pages p on c.source is not distinct from p.source
  where c.n >= 5 and c.n > p.n * 0.05 group by c.source),
kept as (
  select s.doc_id, s.source, s.text, s.lines,
    list_filter(s.lines, lambda x: trim(x) = '' or not list_contains(a.found, x)) as kept, a.found
  from split s left join above a on s.source is not distinct from a.source)
select doc_id, case when found is null or text is null then text else array_to_string(kept, chr(10)) end as text,
  cast(case when found is null or text is null then 0 else len(lines) - len(kept) end as bigint) as lines_dropped
from kept
"""
