"""Secret scan: keyword prefilter, anchored expressions near hits, checks of embedded checksums.

One Aho-Corasick pass over the folded text finds every keyword. A rule is tried only at a hit of one of its
keywords, anchored there; then its check decides. Only ``hex`` has no keyword: its anchor is a run of 16 hex digits.

Results by case: NULL and empty texts have no spans; copies of a row get the same spans; every input row gives one
row; an empty table gives an empty one. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seatwise.llm.text import fold, texts_of

Span = tuple[str, int, int]


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched at a hit of a keyword; ``check`` sees the match and may refuse it.

    Matches of a kind do not overlap: a match that the check refuses still uses up its characters.
    """

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern[str]
    check: Callable[[re.Match[str]], bool]


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, width: int) -> str:
    digits = ""
    while number:
        number, rest = divmod(number, 62)
        digits = _BASE62[rest] + digits
    return digits.rjust(width, "0")


def crc_tail(match: re.Match[str]) -> bool:
    """The last six characters are the CRC-32 of the 30 before them, in base 62."""
    body = match["body"]
    return base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def jwt_header(match: re.Match[str]) -> bool:
    """The first part is Base64 of a JSON object that names an algorithm."""
    part = match["head"]
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError):
        return False
    return isinstance(header, dict) and "alg" in header


def _always(match: re.Match[str]) -> bool:
    return True


# Kinds, keywords and formats. The first two and HEX are the base kinds.
RULES = (
    Rule(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        lambda m: len(m[1]) >= 12,
    ),
    Rule("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_(?P<body>[A-Za-z0-9]{36})(?![A-Za-z0-9])"), crc_tail),
    Rule("npm", ("npm_",), re.compile(r"npm_(?P<body>[A-Za-z0-9]{36})(?![A-Za-z0-9])"), crc_tail),
    Rule("jwt", ("eyj",), re.compile(r"(?P<head>eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), jwt_header),
    Rule("google", ("aiza",), re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"), _always),
    Rule("slack", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), _always),
    Rule("stripe", ("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}"), _always),
    Rule("private_key", ("-----begin",), re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"), _always),
)
HEX = re.compile(r"[0-9a-f]{16,}")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, *(r.kind for r in RULES[2:]))


class Scanner:
    """The rules with one automaton for all their keywords."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.automaton = ahocorasick.Automaton()
        for number, rule in enumerate(rules):
            for word in rule.keywords:
                self.automaton.add_word(word, (number, len(word)))
        self.automaton.make_automaton()
        self.order = {kind: i for i, kind in enumerate(KINDS)}

    def spans(self, text: str) -> list[Span]:
        """All spans by start, then kind in the order of ``KINDS``; offsets in code points, end exclusive."""
        starts: dict[int, list[int]] = {}
        for last, (number, length) in self.automaton.iter(fold(text)):
            starts.setdefault(number, []).append(last - length + 1)
        found = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        for number, hits in starts.items():
            rule, free = self.rules[number], 0
            for at in sorted(hits):
                if at >= free and (match := rule.pattern.match(text, at)):
                    free = match.end()
                    if rule.check(match):
                        found.append((rule.kind, at, free))
        return sorted(found, key=lambda s: (s[1], self.order[s[0]], s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, spans)``: the secrets of each whole text. No shuffle; one batch of rows in memory."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch, texts in texts_of(batches):
            rows = [
                [{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(text)] for text in texts
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, SPANS)], ["doc_id", "spans"])

    read = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(scan, f"doc_id {id_type}, spans array<struct<kind string, start bigint, end bigint>>")
