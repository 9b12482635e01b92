"""Exact and near matches beside plain loops over all windows."""

from collections import Counter
from dataclasses import replace

import pytest

from seatwise.llm import decontaminate, queries
from seatwise.llm.decontaminate import DecontaminationConfig
from tests.compare import compare, duck
from tests.llm.helpers import documents, plain_words, sha

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [
    (1, PASSAGE), (2, "one two three"), (3, "one two three"), (10, "Beta gamma DELTA epsilon zeta eta theta iota kappa lambda mu nu"),
    (None, "lonely words"), (5, ""), (6, None), (7, "the the the the the the the the the the the"), (7, "rare quartz sphinx vow judges"), (8, "solo"),
]
TEXTS = [
    None, "", "...", PASSAGE, f"x {PASSAGE.upper()} y", "one two. three one two three", "one two", "lonely, words lonely words",
    "the " * 40, "alpha beta gamma delta epsilon", "sphinx of black quartz rare x judges my vow", "solo " * 30, "so lo",
    "filler words here " * 4000 + PASSAGE, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "kappa lambda mu nu " + PASSAGE,
    "rare " + "x " * 29 + "quartz sphinx vow judges", "rare " + "x " * 30 + "quartz sphinx vow judges",
]


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "item_id bigint, text string, block int, term string")


def windows():
    found = {}
    for item, text in ITEMS:
        words = plain_words(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            found.setdefault(tuple(words[i : i + 10]), set()).add("" if item is None else str(item))
    return found


def expected(text):
    words, hit, items = plain_words(text), set(), set()
    for window, owners in windows().items():
        for i in range(len(words) - len(window) + 1):
            if tuple(words[i : i + len(window)]) == window:
                hit.update(range(i, i + len(window)))
                items |= owners
    return len(words), len(hit), items


def near(texts, config):
    """Items whose rarest terms, by their count in all texts, stand near an occurrence of the rarest."""
    frequency = Counter(w for t in texts for w in plain_words(t))
    terms = {}
    for item, text in ITEMS:
        terms.setdefault("" if item is None else str(item), set()).update(plain_words(text))
    found = []
    for text in texts:
        words, items = plain_words(text), set()
        places = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        for item, own in terms.items():
            rare = sorted(own, key=lambda w: (frequency[w], w))[: config.rare_terms]
            if rare and any(
                all(any(abs(p - q) <= config.near_span for q in places.get(w, [])) for w in rare[1:]) for p in places.get(rare[0], [])
            ):
                items.add(item)
        found.append(items)
    return found


@pytest.mark.parametrize("changes", [{}, {"chunk_words": 20}, {"block_words": 15, "chunk_words": 1000}])
def test_matches(spark, changes):
    config = replace(DecontaminationConfig(), **changes)
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, benchmark(spark, ITEMS), config).collect()}
    assert len(got) == len(TEXTS)
    nearby = near(TEXTS, config)
    for i, text in enumerate(TEXTS):
        n, hit, items = expected(text)
        row = got[i]
        assert (row["n_words"], sum(r["end"] - r["start"] for r in row["runs"]), set(row["items"])) == (n, hit, items), (i, text)
        assert len(row["items"]) == len(items)
        assert set(row["near_items"]) == nearby[i], (i, text)


def test_query_and_repeated_rows(spark, monkeypatch):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], None), (3, TEXTS[3], "s")]
    tables = {"documents": documents(spark, rows), "benchmark": benchmark(spark, ITEMS)}
    monkeypatch.setattr(queries, "table", lambda spark, sf, name: tables[name])
    got = queries.QUERIES["op7_decontamination"](spark, "").collect()
    assert len(got) == len(rows)
    for row in got:
        n, hit, items = expected(TEXTS[3 if row["doc_id"] is None else row["doc_id"]])
        assert tuple(row)[1:6] == (n, hit, len(items), sha(",".join(sorted(items))), hit > 0)


def test_filter_keeps_clean_rows(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "clean words", None), (None, PASSAGE, None), (0, None, "s")]
    docs = documents(spark, rows)
    left = decontaminate.without_contaminated(docs, benchmark(spark, ITEMS))
    assert left.columns == docs.columns
    clean = sorted((i is None, i or 0) for i, t, _ in rows if not expected(t)[1])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == clean


def test_empty_tables(spark):
    docs = documents(spark, [(1, "a b", "s")])
    assert decontaminate.contamination(documents(spark, []), benchmark(spark, ITEMS)).count() == 0
    row = decontaminate.contamination(docs, benchmark(spark, [])).first()
    assert (row["n_words"], row["runs"], row["items"]) == (2, [], [])


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(queries.QUERIES["op7_decontamination"](spark, sf), duck(sf), queries.ORACLES["op7_decontamination"]) is None
