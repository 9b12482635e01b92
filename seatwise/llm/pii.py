"""Personal data: candidate spans, voting labelers, reliabilities by expectation-maximisation, a span classifier.

DataFrame expressions only. One pass over the texts finds candidate spans with their votes and traits; they are written as
a stage table, so the texts are read once. All further work is on counts of patterns of votes and traits, of which there is
a bounded number however large the corpus: they are what the driver sees.

Votes say whether a candidate is personal; traits (how many digits, how varied, where on its line) say nothing by
themselves, so expectation-maximisation sees the votes alone and the classifier sees both. Every span carries its score. A
candidate of a base kind that passes its check is always a span. Other kinds (numbers of accounts, persons, and so on) are
spans where the classifier says so.

Results by case: NULL and empty texts have no spans; copies of a row get equal results; an empty table gives an
empty one; ids may be NULL or repeat, since rows have a key of their own. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seatwise.workspace import stage

# Given names in frequent use in four languages, and titles.
GIVEN_NAMES = (
    "Alejandro|Alexander|Alice|Ana|Andreas|Andrew|Anna|Anne|Antoine|Antonio|Barbara|Carlos|Carmen|Caroline|Charles|Charlotte|"
    "Christian|Christine|Claire|Claudia|Daniel|David|Diego|Elena|Elizabeth|Emily|Emma|Fernando|Francisco|Frank|Fritz|George|"
    "Hans|Heinrich|Helen|Henri|Isabel|Jack|Jacques|James|Javier|Jean|Jennifer|Johann|John|José|Juan|Julia|Julie|Karl|Katharina|"
    "Klaus|Laura|Linda|Louis|Lucas|Lucía|Luis|Manuel|Margaret|Maria|María|Marie|Mark|Martin|Mary|Matthias|Michael|Michel|"
    "Miguel|Nicolas|Oliver|Pablo|Patricia|Paul|Pedro|Peter|Philippe|Pierre|Rafael|Richard|Robert|Sabine|Sarah|Sophie|Stefan|"
    "Susan|Susanne|Teresa|Thomas|Ursula|Walter|William|Wolfgang"
)
TITLES = r"Mr\.?|Mrs\.?|Ms\.?|Dr\.|Prof\.|Herr|Frau|Mme\.?|Madame|Monsieur|Señor|Señora|Sra?\."

# Base kinds in their order, then the kinds that the classifier decides on.
# The patterns find what the plain ones do: a look behind and possessive loops keep them linear on long runs.
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])",
    "account": r"(?<![0-9A-Za-z.+:-])(?<!\+[0-9]{1,3} )[0-9]{8,19}(?![0-9A-Za-z-])",
    "person": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{TITLES})\x20(?:(?:{GIVEN_NAMES})\x20)?|(?:{GIVEN_NAMES})\x20)\p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})",
}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
# Texts without this character have no candidate of the kind.
NEEDED = {"email": "@", "ip": ".", "phone": "+", "ssn": "-", "mac": ":"}

# Word lists of the labelers.
DOMAINS = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|eu"
HELPING = "mail|email|e-mail|contact|phone|tel|telephone|call|mobile|fax|card|visa|payment|ip|address|host|ssn|social|iban|account|mac|name|dear|signed|author|regards|sincerely|konto|cuenta|compte"
HINDERING = "saint|prize|university|street|version|release|order|invoice|isbn|sku|hash|commit|build|part|serial|chapter|section"


@dataclass(frozen=True)
class PiiConfig:
    """``context`` characters before a candidate are seen by the context labelers."""

    context: int = 40
    rounds: int = 50
    smoothing: float = 1.0
    first_accuracy: float = 0.8
    steps: int = 400
    learning_rate: float = 0.5
    threshold: float = 0.5


LABELERS = ("format", "check", "gazetteer", "helping", "hindering", "border")
TRAITS = ("numeric", "varied", "opening")


def candidates(docs: DataFrame, id_column: str, text_column: str, context: int) -> DataFrame:
    """``(_row, doc_id, kind, start, end, match, before, after)``; a row without candidates has one with NULL kind.

    Offsets are running sums over a text's pieces between matches, taken in a window after the texts are gone.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).alias("doc_id"), text.alias("_text"))

    def of_kind(kind: str) -> Column:
        pattern = F.lit(PATTERNS[kind])
        found = F.regexp_extract_all("_text", pattern, F.lit(0))
        pieces = F.split("_text", PATTERNS[kind], -1)
        rows = F.transform(
            F.arrays_zip(pieces.alias("piece"), found.alias("match")),
            lambda x, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("i"),
                F.length(x["piece"]).alias("gap"),
                x["match"].alias("match"),
                F.right(x["piece"], F.lit(context)).alias("before"),
                F.left(x["piece"], F.lit(1)).alias("first"),
            ),
        )
        there = F.regexp_like("_text", pattern)
        if kind in NEEDED:
            there = F.contains("_text", F.lit(NEEDED[kind])) & there
        return F.when(there, rows).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,match:string,before:string,first:string>>"))

    exploded = read.select("_row", "doc_id", F.explode_outer(F.concat(*[of_kind(k) for k in KINDS])).alias("c"))
    flat = exploded.select("_row", "doc_id", "c.*").repartition("_row")
    order = Window.partitionBy("_row", "kind").orderBy("i")
    length = F.coalesce(F.length("match"), F.lit(0))
    placed = flat.select(
        "_row", "doc_id", "kind", "match", "before",
        F.lead("first").over(order).alias("after"),
        F.sum(F.col("gap") + length).over(order).cast("bigint").alias("end"),
        length.alias("length"),
    )
    # The last piece of a kind has no match; it stays only as the single row of a document without any candidate.
    return placed.filter(F.col("match").isNotNull() | F.col("kind").isNull()).select(
        "_row", "doc_id", "kind", (F.col("end") - F.col("length")).alias("start"), "end", "match", "before", "after"
    )


def with_votes(spans: DataFrame) -> DataFrame:
    """Add ``passes``, one vote of 1, 0 or -1 per labeler and traits of 0 or 1; match and context texts go.

    A card's number is no account beside it.
    """
    kind, match = F.col("kind"), F.col("match")
    yes = lambda c: F.when(c, 1).otherwise(-1)
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    in_range = F.regexp_like(match, F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"))
    passes = (
        F.when(kind == "email", True)
        .when(kind == "ip", in_range)
        .when(kind == "card", n.between(16, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", n.between(8, 15))
        .when(kind == "ssn", ~F.regexp_like(match, F.lit("^(?:000|666|9)|-00-|-0000$")))
        .when(kind == "account", ~(n.between(16, 19) & F.call_function("luhn_check", digits)))
        .otherwise(True)
    )
    strict = (
        F.when(kind == "email", F.regexp_like(match, F.lit(r"^[A-Za-z0-9][^@]*[A-Za-z0-9]@[^@]+\.[A-Za-z]{2,}$")))
        .when(kind == "ip", F.regexp_like(match, F.lit(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")))
        .when(kind == "card", F.regexp_like(match, F.lit(r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}$")))
        .when(kind == "phone", F.regexp_like(match, F.lit(r"^\+[0-9]{1,3}[ .(-]")))
        # No date, no round number.
        .when(kind == "account", ~F.regexp_like(match, F.lit(r"^(?:19|20)[0-9]{6}(?:[0-9]{6})?$|0000$")))
        .when(kind == "person", ~F.regexp_like(match, F.lit(r"\p{Lu}\p{Ll}$")))
        .otherwise(True)
    )
    # An IBAN's letters count 10 to 35 and its first four characters stand last; the number is 1 modulo 97.
    turned = F.concat(F.substring(match, 5, 40), F.substring(match, 1, 4))
    mod_97 = F.aggregate(
        F.split(F.when(kind == "iban", turned), ""),
        F.lit(0),
        lambda r, c: F.when(
            c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97
        ).otherwise((r * 100 + F.ascii(c) - 55) % 97),
    )
    checked = (
        F.when(kind == "iban", yes(mod_97 == 1))
        .when(kind == "account", yes(F.call_function("luhn_check", digits)))
        .when(kind.isin("person", "mac"), 0)
        .otherwise(yes(passes))
    )
    listed = (
        F.when(kind == "email", F.when(F.regexp_like(match, F.lit(rf"(?i)\.(?:{DOMAINS})$")), 1).otherwise(0))
        .when(kind == "ip", F.when(F.regexp_like(match, F.lit(r"^(?:0|127|255)\.|\.0\.0\.0$")), -1).otherwise(0))
        .when(kind == "card", F.when(F.regexp_like(digits, F.lit("^(?:4|5[1-5]|2[2-7]|3[47]|6)")), 1).otherwise(-1))
        .when(kind == "phone", F.when(F.regexp_like(match, F.lit(r"^\+(?:1|33|34|39|44|49)[^0-9]")), 1).otherwise(0))
        .when(kind == "person", F.when(F.regexp_like(match, F.lit(rf"(?:^|\x20)(?:{GIVEN_NAMES})\x20")), 1).otherwise(0))
        .otherwise(0)
    )
    word = lambda w: F.regexp_like("before", F.lit(rf"(?i)(?<![a-z])(?:{w})(?![a-z])"))
    glued = F.regexp_like("before", F.lit("[A-Za-z0-9]$")) | F.coalesce(F.regexp_like("after", F.lit("^[A-Za-z0-9]")), F.lit(False))
    votes = {
        # Nearly all candidates are well formed and stand alone, which is no sign of anything: only the opposite is a vote.
        "format": F.when(strict, 0).otherwise(-1),
        "check": checked,
        "gazetteer": listed,
        "helping": F.when(word(HELPING), 1).otherwise(0),
        "hindering": F.when(word(HINDERING), -1).otherwise(0),
        "border": F.when(glued, -1).otherwise(0),
    }
    seen = lambda c: F.when(c, 1).otherwise(0)
    traits = {
        "numeric": seen(n * 2 > F.length(match)),
        "varied": seen(F.length(F.regexp_replace(digits, r"([0-9])(?=.*\1)", "")) >= 5),
        "opening": seen(F.regexp_like("before", F.lit(r"(?:^|[\n:=(|])\s*$"))),
    }
    return spans.select(
        "_row", "doc_id", "kind", "start", "end", passes.alias("passes"),
        *[v.cast("int").alias(k) for k, v in (votes | traits).items()],
    )


# Kind, votes and then traits, and how many candidates have them.
Pattern = tuple[str, tuple[int, ...], int]


def reliabilities(patterns: Sequence[Pattern], config: PiiConfig) -> tuple[dict[str, float], list[float], list[float]]:
    """Prior by kind, accuracy by labeler and the probability of each pattern, by expectation-maximisation.

    One-coin model: a labeler that votes is right with a probability of its own, given the truth; 0 says nothing.
    """
    accuracy = [config.first_accuracy] * len(LABELERS)
    prior = {kind: 0.5 for kind, _, _ in patterns}
    truth: list[float] = []
    for _ in range(config.rounds):
        truth = []
        for kind, votes, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            odds += sum(v * math.log(a / (1 - a)) for v, a in zip(votes[: len(LABELERS)], accuracy, strict=True))
            truth.append(sigmoid(odds))
        s = config.smoothing
        for j in range(len(LABELERS)):
            right = voted = 0.0
            for (_, votes, n), p in zip(patterns, truth, strict=True):
                if votes[j]:
                    voted += n
                    right += n * (p if votes[j] > 0 else 1 - p)
            accuracy[j] = min(0.99, max(0.5, (right + 4 * s) / (voted + 5 * s)))
        for kind in prior:
            rows = [(n, p) for (k, _, n), p in zip(patterns, truth, strict=True) if k == kind]
            prior[kind] = min(0.99, max(0.01, (sum(n * p for n, p in rows) + s) / (sum(n for n, _ in rows) + 2 * s)))
    return prior, accuracy, truth


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def fit_classifier(patterns: Sequence[Pattern], truth: Sequence[float], config: PiiConfig) -> dict[str, float]:
    """Logistic weights of kinds, votes and traits on the probabilities of the patterns, each weighted by its count."""
    names = (*LABELERS, *TRAITS)
    weights = {f"kind:{k}": 0.0 for k in KINDS} | dict.fromkeys(names, 0.0)
    total = sum(n for _, _, n in patterns)
    for _ in range(config.steps if total else 0):
        slope = dict.fromkeys(weights, 0.0)
        for (kind, seen, n), p in zip(patterns, truth, strict=True):
            miss = n / total * (p - sigmoid(weights[f"kind:{kind}"] + sum(weights[x] * v for x, v in zip(names, seen, strict=False))))
            slope[f"kind:{kind}"] += miss
            for name, v in zip(names, seen, strict=False):
                slope[name] += miss * v
        for name, s in slope.items():
            weights[name] += config.learning_rate * s
    return weights


def pii_spans(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", config: PiiConfig = PiiConfig()
) -> DataFrame:
    """``(doc_id, spans)``: spans ``(kind, start, end, score)`` in the order of ``KINDS``, then by start."""
    found = stage(with_votes(candidates(docs, id_column, text_column, config.context)), "pii")
    # At most 9 kinds times 3 ** 6 votes times 2 ** 3 traits; most votes have two values, so it is far less.
    seen = (*LABELERS, *TRAITS)
    # A card's number counts as a card alone.
    counts = found.filter(F.col("kind").isNotNull() & ((F.col("kind") != "account") | F.col("passes"))).groupBy("kind", *seen).count().collect()
    patterns = sorted((r["kind"], tuple(r[x] for x in seen), r["count"]) for r in counts)
    _, _, truth = reliabilities(patterns, config)
    weights = fit_classifier(patterns, truth, config)

    margin = sum((F.col(name) * weights[name] for name in seen), F.lit(0.0))
    bias = F.coalesce(*[F.when(F.col("kind") == k, F.lit(weights[f"kind:{k}"])) for k in KINDS])
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(margin + bias)))
    base = F.col("kind").isin(*BASE_KINDS)
    kept = F.when(base, F.col("passes")).otherwise(F.col("passes") & (score >= config.threshold))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(
        F.coalesce(kept, F.lit(False)),
        F.struct(place.alias("place"), "start", "end", "kind", score.alias("score")),
    )
    # One group is the spans of one text. collect_list leaves out NULL.
    grouped = found.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("_spans"))
    return grouped.select(
        "doc_id",
        F.transform(
            "_spans",
            lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")),
        ).alias("spans"),
    )
