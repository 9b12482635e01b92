"""License scan: ordered signature rules behind a keyword prefilter, in DataFrame expressions only.

A text becomes its words with single spaces between them. One expression finds the keywords; the rules of those
keywords, and no others, are then matched. Detections are word intervals. One that lies inside another goes; of two
that overlap otherwise, the one whose rule has the lower priority goes. Base phrases are reported wherever they stand.

No shuffle: each row is scanned on its own. Results by case: NULL and empty texts have no words, no labels and score 0;
copies of a row get equal results; an empty table gives an empty one. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seatwise.llm.text import LOWER, UPPER, joined_words


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against whole words of the lower-case joined text; lower priority numbers win."""

    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    base: bool = False


# The base phrases and their labels.
BASE = (
    Rule("cc-by", "cc", "cc by", 0, 0.5, True),
    Rule("gpl", "general", "general public license", 0, 0.6, True),
    Rule("reserved", "rights", "all rights reserved", 0, 0.5, True),
)

# Label, keyword, the name as words, the short identifier as words, which starts with a plain word.
NAMES = (
    ("mit", "mit", "mit", "mit"),
    ("mit-0", "mit", "mit no attribution", "mit 0"),
    ("apache-2.0", "apache", "apache(?: software)? license(?: version)? 2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", "apache(?: software)? license(?: version)? 1 1", "apache 1 1"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:modified bsd|new bsd|bsd 3 clause|3 clause bsd)", "bsd 3 clause"),
    ("bsd", "bsd", "bsd", "bsd"),
    ("gpl-2.0", "gnu", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gnu", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-any", "gnu", "gnu general public license", "gnu gpl"),
    ("lgpl-2.1", "gnu", "gnu lesser general public license (?:version|v) 2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "gnu", "gnu lesser general public license (?:version|v) 3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "affero", "gnu affero general public license(?: (?:version|v) 3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: (?:version|v))?(?: 2 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public license(?: (?:version|v))? 1 0", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public license(?: (?:version|v))? 2 0", "epl 2 0"),
    ("cddl-1.0", "cddl", "common development and distribution license cddl", "cddl 1 0"),
    ("isc", "isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license wtfpl", "wtfpl"),
    ("artistic-2.0", "artistic", "artistic license(?: version)? 2 0", "artistic 2 0"),
    ("boost-1.0", "boost", "boost software license(?: version)? 1 0", "bsl 1 0"),
    ("python-2.0", "python", "python software foundation license", "python 2 0"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("eupl-1.2", "eupl", "european union public licen[cs]e eupl(?: v?1 2)?", "eupl 1 2"),
    ("ofl-1.1", "ofl", "sil open font license ofl(?: (?:version )?1 1)?", "ofl 1 1"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-3.0", "cc", "cc by 3 0", "cc by 3 0"),
    ("cc-by-4.0", "cc", "cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-3.0", "cc", "cc by sa 3 0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc", "cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-3.0", "cc", "cc by nc 3 0", "cc by nc 3 0"),
    ("cc-by-nc-4.0", "cc", "cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "cc", "cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc", "cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc", "cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-by-4.0", "creative", "creative commons attribution(?: 4 0)?(?: international)?", "creative commons by 4 0"),
    ("cc-by-sa-4.0", "creative", "creative commons attribution share ?alike(?: 4 0)?(?: international)?", "creative commons by sa 4 0"),
    ("cc-by-nc-4.0", "creative", "creative commons attribution non ?commercial(?: 4 0)?(?: international)?", "creative commons by nc 4 0"),
    ("public-domain", "domain", "public domain", "public domain"),
)

# Ways to name a license; {name} and {id} are filled in, earlier ones have priority.
FORMS = (
    ("spdx license identifier {id}", 0.99),
    ("(?:is|are|be)? ?licensed under (?:the )?(?:terms of the )?{name}(?: licen[cs]e)?", 0.98),
    ("(?:is|are|be)? ?(?:released|distributed|published|available) under (?:the )?(?:terms of the )?{name}(?: licen[cs]e)?", 0.97),
    ("permission is (?:hereby )?granted under (?:the )?{name}(?: licen[cs]e)?", 0.95),
    ("under (?:the )?(?:terms of (?:the )?)?{name} licen[cs]e", 0.9),
    ("licen[cs]e {id}", 0.85),
    ("{name} licen[cs]e", 0.8),
    ("see (?:the )?{name}(?: licen[cs]e)? for details", 0.75),
)

# Rules that are not made from a name.
PLAIN = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("apache-2.0", "apache", "apache license version 2 0(?: the license)?", 0.95),
    ("proprietary", "proprietary", "proprietary and confidential", 0.7),
    ("proprietary", "reproduction", "(?:unauthorized )?reproduction (?:or distribution )?is (?:strictly )?prohibited", 0.6),
    ("warranty", "warranty", "(?:provided )?as is without warranty of any kind", 0.4),
    ("copyright", "copyright", "copyright (?:c )?[0-9]{4}", 0.4),
)


def keyword_of(keyword: str, short: str) -> str:
    """The keyword where the short identifier has it, else the first word of the identifier."""
    found = short.split(" ")
    return keyword if keyword in found else found[0]


def signature_rules() -> tuple[Rule, ...]:
    """All rules in order of priority: forms of names, more telling forms first, then the plain ones, then base."""
    rules = [
        Rule(label, keyword_of(keyword, short) if "{id}" in form else keyword, form.replace("{name}", name).replace("{id}", short), i, confidence)
        for i, (form, confidence) in enumerate(FORMS)
        for label, keyword, name, short in NAMES
    ]
    # A full name speaks for itself; "mit" or "bsd" alone do not.
    rules += [Rule(label, keyword, name, len(FORMS), 0.7) for label, keyword, name, _ in NAMES if "licen" in name]
    rules += [Rule(label, keyword, pattern, len(FORMS), score) for label, keyword, pattern, score in PLAIN]
    return (*rules, *BASE)


def _whole_words(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _intervals(spaced: Column, pattern: Column, rule: Column) -> Column:
    """Word intervals of a pattern in ' word word … '; linear in the text: matches are marked, then words counted."""
    marked = F.split(F.regexp_replace(F.trim(F.regexp_replace(spaced, pattern, F.lit("\u0001$0"))), "^ +", ""), " ")
    starts = F.filter(
        F.transform(marked, lambda word, i: F.when(F.startswith(word, F.lit("\u0001")), i)), lambda i: i.isNotNull()
    )
    lengths = F.transform(
        F.regexp_extract_all(spaced, pattern, F.lit(0)),
        lambda m: F.length(F.trim(m)) - F.length(F.replace(F.trim(m), F.lit(" "), F.lit(""))) + 1,
    )
    return F.transform(
        F.arrays_zip(starts.alias("at"), lengths.alias("n")),
        lambda x: F.struct(
            x["at"].cast("bigint").alias("start"),
            (x["at"] + x["n"]).cast("bigint").alias("end"),
            rule["priority"].alias("priority"),
            rule["label"].alias("label"),
            rule["confidence"].alias("confidence"),
        ),
    )


def license_detections(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    """``(doc_id, n_words, base, kept)``: base places and the other detections that survive, as word intervals."""
    rules = signature_rules() if rules is None else rules
    table = F.array(
        *[
            F.struct(
                F.lit(r.label).alias("label"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(_whole_words(r.pattern)).alias("pattern"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.confidence).alias("confidence"),
                F.lit(r.base).alias("base"),
            )
            for r in rules
        ]
    )
    keywords = "|".join(sorted({r.keyword for r in rules}))
    joined = joined_words(F.col(text_column))
    found = F.regexp_extract_all("_joined", F.lit(f"(?i)(?<![^ ])(?:{keywords})(?![^ ])"), F.lit(0))
    read = docs.select(F.col(id_column).alias("doc_id"), joined.alias("_joined")).select(
        "doc_id", "_joined", F.array_distinct(F.transform(found, F.lower)).alias("_hits")
    )
    n_words = F.when(F.col("_joined") == "", 0).otherwise(
        F.length("_joined") - F.length(F.replace("_joined", F.lit(" "), F.lit(""))) + 1
    )
    gated = read.select(
        "doc_id",
        n_words.cast("bigint").alias("n_words"),
        F.when(F.size("_hits") > 0, F.concat(F.lit(" "), F.translate("_joined", UPPER, LOWER), F.lit(" "))).alias("_spaced"),
        F.filter(table, lambda r: F.array_contains(F.col("_hits"), r["keyword"])).alias("_rules"),
    )

    def detect(base: bool) -> Column:
        chosen = F.filter("_rules", lambda r: r["base"] == base)
        hit = F.filter(chosen, lambda r: F.regexp_like("_spaced", r["pattern"]))
        return F.flatten(F.transform(hit, lambda r: _intervals(F.col("_spaced"), r["pattern"], r)))

    empty = F.array().cast("array<struct<start bigint, end bigint, priority int, label string, confidence double>>")
    staged = gated.select(
        "doc_id",
        "n_words",
        F.when(F.col("_spaced").isNotNull(), detect(True)).otherwise(empty).alias("base"),
        F.when(F.col("_spaced").isNotNull(), detect(False)).otherwise(empty).alias("_all"),
    )
    return staged.select("doc_id", "n_words", "base", surviving(F.col("_all")).alias("kept"))


def surviving(found: Column) -> Column:
    """Detections left after containment, then priority.

    Sorted by start, longest first, better priority first, a detection lies inside another exactly if it ends no later
    than one before it does. What is left has growing starts and ends; each pair of neighbours that overlap
    loses the one of worse priority, the later one if equal. One pass each over the sorted array.
    """
    ordered = F.array_sort(
        F.transform(
            found,
            lambda d: F.struct(
                d["start"].alias("start"), (-d["end"]).alias("back"), d["priority"].alias("priority"),
                d["label"].alias("label"), d["confidence"].alias("confidence"),
            ),
        )
    )
    kept_type = "array<struct<start:bigint,back:bigint,priority:int,label:string,confidence:double>>"

    def step(kept: Column, d: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        inside = last.isNotNull() & (last["back"] <= d["back"])
        overlap = last.isNotNull() & (d["start"] < -last["back"])
        better = d["priority"] < last["priority"]
        return (
            F.when(inside, kept)
            .when(overlap & ~better, kept)
            .when(overlap & better, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(d)))
            .otherwise(F.concat(kept, F.array(d)))
        )

    kept = F.aggregate(ordered, F.array().cast(kept_type), step)
    return F.transform(
        kept,
        lambda d: F.struct(
            d["start"].alias("start"), (-d["back"]).alias("end"), d["label"].alias("label"), d["confidence"].alias("confidence")
        ),
    )


def license_report(detections: DataFrame) -> DataFrame:
    """One row per document: counts, first and last base place, labels and a score (the best confidence)."""
    starts = F.transform("base", lambda d: d["start"])
    labels = lambda c: F.transform(c, lambda d: d["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    confidence = F.array_max(F.concat(F.transform("base", lambda d: d["confidence"]), F.transform("kept", lambda d: d["confidence"])))
    return detections.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(labels("base")).alias("base_labels"),
        joined(F.concat(labels("base"), labels("kept"))).alias("labels"),
        F.coalesce(confidence, F.lit(0.0)).alias("score"),
    )
