"""Boilerplate lines beside a plain loop and SQL."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seatwise.llm import line_dedup, queries
from seatwise.llm.line_dedup import LineConfig
from tests.compare import compare, duck
from tests.llm.helpers import documents


def expected(rows, config):
    pages, having = Counter(s for _, _, s in rows), Counter()
    for _, text, source in rows:
        having.update({(source, x) for x in (text or "").split("\n") if x.strip(" ")} if text is not None else ())
    drop = {(s, x) for (s, x), n in having.items() if n >= config.min_pages and n > config.ratio * pages[s]}
    out = []
    for i, text, source in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if (source, x) not in drop]
        out.append((i, text if len(kept) == len(lines) else "\n".join(kept), len(lines) - len(kept)))
    return out


ROWS = (
    [(i, f"menu\n\nown {i}\nmenu\n  ", "a") for i in range(8)] + [(i, f"own {i}\nfooter", "a") for i in range(8, 60)]
    + [(i, "menu\nonly here", None) for i in range(60, 70)] + [(70, None, "a"), (71, "", "a"), (72, "menu", "b"), (73, "menu\r\nx", "b"), (None, "footer\nz", "a")]
    + [(8, "own 8\nfooter", "a")] * 2 + [(80, "line\n" * 30000, "c")]
)


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "MAX_BROADCAST_LINES", -1)
    config = LineConfig(ratio=0.1, min_pages=3)
    docs = documents(spark, ROWS).withColumnRenamed("row", "Lines_Dropped")
    got = line_dedup.drop_boilerplate(docs, "source", config=config)
    assert got.columns == [c for c in docs.columns if c != "Lines_Dropped"] + ["lines_dropped"]
    assert Counter((r["doc_id"], r["text"], r["lines_dropped"]) for r in got.collect()) == Counter(expected(ROWS, config))


def test_pipeline_cuts_lines_of_one_language(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = corpus_pipeline.drop_boilerplate_lines(spark, docs, sf)
    counts = lambda df: Counter(
        {r["line"]: r["count"] for r in df.select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).groupBy("line").count().collect()}
    )
    before, after = counts(docs), counts(left)
    for start, most in (("En laleenéelle", 0), ("Nicht aulich", 0), ("Ascirr para", 30)):
        line = max((x for x in before if x.startswith(start)), key=before.get)
        assert before[line] > 150 and after[line] <= most, line
    assert all(after[x] == 1 for x, n in before.items() if n == 1)
    assert left.filter((F.trim("text") == "") & (F.col("n_chars") > 0)).count() == docs.filter((F.trim("text") == "") & (F.col("n_chars") > 0)).count()


def test_empty_table(spark):
    assert line_dedup.drop_boilerplate(documents(spark, []), "source").count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(queries.QUERIES["op10_line_dedup"](spark, sf), duck(sf), queries.ORACLES["op10_line_dedup"]) is None


def test_line_keys_have_no_common_half(spark):
    """Keys are one value of 128 bits, and different lines have different ones."""
    keys = spark.range(200_000).select(line_dedup._line_key(F.col("id").cast("string")).alias("key"))
    assert keys.distinct().count() == 200_000 and keys.filter("length(key) <> 32").count() == 0
    halves = keys.agg(F.count_distinct(F.substring("key", 1, 16)), F.count_distinct(F.substring("key", 17, 16))).first()
    assert tuple(halves) == (200_000, 200_000)


def test_a_text_of_very_many_lines_takes_time_in_proportion(spark):
    """200,000 different lines in one text, some of them boilerplate of their host."""
    common = [f"common {i}" for i in range(20)]
    long = "\n".join(f"line {i}\n{common[i % 20]}" for i in range(100_000))
    rows = [(0, long, "a")] + [(i, "\n".join([*common, f"own {i}"]), "a") for i in range(1, 30)]
    start = time.perf_counter()
    found = {r.doc_id: r for r in line_dedup.drop_boilerplate(documents(spark, rows), "source", config=LineConfig(ratio=0.5)).collect()}
    assert time.perf_counter() - start < 60
    assert found[0].lines_dropped == 100_000 and found[0].text == "\n".join(f"line {i}" for i in range(100_000))
    assert all(found[i].text == f"own {i}" and found[i].lines_dropped == 20 for i in range(1, 30))
