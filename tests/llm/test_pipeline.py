"""The pipeline: order of the stages, planted cases, and each stage beside what it should keep."""

import __spark_entry__
import corpus_pipeline
from tests.llm.helpers import plain_words

SF = "/root/testdata/sf0.01"


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] or all(
        any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)
    )


def test_each_stage_keeps_what_it_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        function(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        kept[name] = (before, after)
        if name != "bpe":
            assert docs.columns == columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    before, after = kept["toxicity"]
    assert len(toxic & set(after)) < 0.5 * len(toxic) and len(set(before) - set(after) - toxic) < 0.05 * len(before)
    before, after = kept["line_dedup"]
    assert set(before) == set(after) and all(r["n_chars"] == len(r["text"]) for r in after.values())
    before, after = kept["near_dedup"]
    assert len({r["text"] for r in after.values() if plain_words(r["text"])}) == len([1 for r in after.values() if plain_words(r["text"])])
    first = {}
    for i in sorted(before):
        first.setdefault(before[i]["text"], i)
    assert all(first[before[i]["text"]] == i for i in after if plain_words(before[i]["text"]))
    before, after = kept["decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = plain_words(r["text"])
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    sizes = {len(w) for w in windows}
    for i, row in before.items():
        words = plain_words(row["text"])
        clean = not any(tuple(words[a : a + n]) in windows for n in sizes for a in range(len(words) - n + 1))
        assert clean == (i in after)
    before, after = kept["bpe"]
    assert set(before) == set(after)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() > 0
