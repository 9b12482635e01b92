"""Quality classifier: learned subword vectors averaged per document into a softmax.

Words are kept as written, with their punctuation, so that symbols and capitals reach the n-grams; a word that
repeats the one before it is followed by a mark. Results by case: NULL and empty texts get the score of a document
without words; copies get equal scores; an empty table gives an empty one; without labels every score is 0.5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from seatwise.llm.subwords import SubwordConfig, SubwordModel, fit, predictions

CONFIG = SubwordConfig(n_grams=(2, 4))
THRESHOLD = 0.3
REPEATED = "\u0001repeated"


def tokens(text: str) -> list[str]:
    words = text.split()
    marks = [REPEATED for a, b in zip(words, words[1:], strict=False) if a == b]
    return words + marks


def fit_quality(docs: DataFrame, labels: DataFrame, config: SubwordConfig = CONFIG) -> SubwordModel:
    return fit(docs, labels, "quality", tokens, config)


def quality_scores(docs: DataFrame, labels: DataFrame, config: SubwordConfig = CONFIG, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    return predictions(docs, fit_quality(docs, labels, config), tokens, threshold)
