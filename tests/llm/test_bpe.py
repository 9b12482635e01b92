"""Ids and decoded texts are those of the tokenizers library."""

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pathlib import Path
from tokenizers import Tokenizer

from seatwise.llm import bpe
from tests.llm.helpers import documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "   \n", "Hello, World! it's we'LL they've 12345", "<|startoftext|>Hi<|endoftext|> <|STARTOFTEXT|> <|startoftext|",
    "Éléphant éléphant ÉLÉPHANT ΣΑΣ İstanbul ŉ K ſ ǅ", "日本語 テスト １２ ½ ² ª º  x y\x1cz\x85w", "👩‍👩‍👧 🏳️‍🌈 éå ﬁ",
    "a" * 5000 + " " + "é" * 3000, "word " * 20000, "\x00\x01 ﻿ ​", "don't 'S 'Re x's", "naïve_café-αβγ ١٢٣",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_and_texts(spark, tokenizer):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "s"), (4, TEXTS[4], "s")]
    for chunk_words in (7, 5_000_000):
        coded = bpe.encode(documents(spark, rows), PATH, chunk_words=chunk_words)
        got = bpe.decode(coded, PATH).collect()
        assert len(got) == len(rows)
        for row in got:
            ids = tokenizer.encode(TEXTS[3 if row["doc_id"] is None else row["doc_id"]] or "", add_special_tokens=False).ids
            assert row["ids"] == ids
            assert row["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_words_of_any_text(tokenizer, text):
    definition = Path(PATH).read_text(encoding="utf-8")
    splitter, encoder = bpe.Splitter(definition), bpe.WordEncoder(definition)
    ids = [i for w in splitter.words(text) for i in encoder.ids(w)]
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_empty_table_and_foreign_ids(spark):
    assert bpe.decode(bpe.encode(documents(spark, []), PATH), PATH).count() == 0
    odd = spark.createDataFrame([([0, 99_999_999, -1, 1],), (None,), ([],)], "ids array<int>")
    assert sorted(r["decoded"] for r in bpe.decode(odd, PATH).collect()) == ["", "", '! "']
