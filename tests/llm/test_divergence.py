"""Source divergence against a plain loop over all terms, and its SQL."""

import random
import re
from collections import Counter, defaultdict

import pytest

from seatwise.llm.divergence import DIVERGENCE_SQL, DivergenceConfig, source_divergence
from tests.compare import compare, duck
from tests.llm.helpers import documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs=3, top=200):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(fold)))) for lang, source, text in rows]
    result = set()
    for lang in {d[0] for d in docs}:
        df, count = Counter(), defaultdict(Counter)
        for own, source, terms in docs:
            if own == lang:
                df.update(terms.keys())
                count[source].update(terms)
        kept = [t for t, n in df.items() if n >= min_docs]
        total = Counter()
        for terms in count.values():
            total.update({t: terms[t] for t in kept})

        def share(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        shares, whole = {s: share(c) for s, c in count.items()}, share(total)
        for s, p in shares.items():
            pairs = [(-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o.encode(), o) for o, q in shares.items() if o != s]
            terms = [(-((p[t] - whole[t]) ** 2 // whole[t]), t.encode(), t) for t in kept if count[s][t] and p[t] > whole[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                result |= {(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(items)}
    return result


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n, sources):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "été", "straße", "日本語", "𝛼β", "x"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    return [
        (rng.choice(["en", "fr", None]), rng.choice(sources), " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 30))))
        for _ in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id int, lang string, source string, text string, term string, docs int").repartition(4)


@pytest.mark.parametrize("config", [DivergenceConfig(), DivergenceConfig(top=5, max_cells=20, bucket_terms=7, block_sources=2)])
def test_equals_plain_loop(spark, config):
    """Also with spills, several buckets of terms and several blocks of sources."""
    rows = corpus(1, 150, ["a", "b", "c", "d", "é", None])
    assert found(source_divergence(frame(spark, rows), config)) == plain(rows, top=config.top)


def test_awkward_rows(spark):
    long = "One two, three. " * 20_000
    rows = [("en", "a", None), ("en", None, ""), (None, "a", "one TWO"), (None, "b", "one two"), (None, None, "two one 12 -"), ("xx", "only", "word")]
    rows += [("en", s, long) for s in ("a", "b", "b")] + [("en", "c", "one one"), ("yy", "a", "1 2 3"), ("yy", "b", "rare")]
    assert found(source_divergence(frame(spark, rows))) == plain(rows)
    assert source_divergence(frame(spark, [])).collect() == []


def test_one_term_in_all_rows_and_repeated_rows(spark):
    rows = [("en", f"s{i % 40}", "common common") for i in range(400)] + [("en", "s0", "other")] * 5
    assert found(source_divergence(frame(spark, rows), DivergenceConfig(max_cells=5, block_sources=7))) == plain(rows)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(source_divergence(spark.read.parquet(f"{sf}/documents.parquet")), duck(sf), DIVERGENCE_SQL) is None


def test_clashing_columns(spark):
    assert found(source_divergence(documents(spark, [(1, "a b", "s"), (2, "a c", "s"), (3, "a", "t")]))) == plain([(None, "s", "a b"), (None, "s", "a c"), (None, "t", "a")])
