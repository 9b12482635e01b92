"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Words are lower case without punctuation; a misspelling shares most of its character n-grams, and so its vector, with
the word it stands for. Results by case: NULL and empty texts get the score of a document without words; copies get
equal scores; an empty table gives an empty one; without labels every score is 0.5. The bias is set so that about 2 %
of clean documents score 0.5 or more, so scores near 0.5 are ranks more than probabilities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seatwise.llm.subwords import SubwordConfig, SubwordModel, fit, predictions, scored
from seatwise.llm.text import WORD

CONFIG = SubwordConfig(learning_rate=3.0, epochs=6, damped=True, neutral=5.0, false_alarms=0.02)
THRESHOLD = 0.5


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def fit_toxicity(docs: DataFrame, labels: DataFrame, config: SubwordConfig = CONFIG) -> SubwordModel:
    return fit(docs, labels, "toxic", tokens, config)


def toxicity_scores(docs: DataFrame, labels: DataFrame, config: SubwordConfig = CONFIG, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    return predictions(docs, fit_toxicity(docs, labels, config), tokens, threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, config: SubwordConfig = CONFIG, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, all columns kept."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return scored(rows, fit_toxicity(docs, labels, config), tokens).filter(F.col("score") < threshold).select("row.*")
