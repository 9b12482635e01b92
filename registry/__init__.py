"""Registered queries: each runs on the given tables and, where SQL can say the same, has an oracle."""

from registry.core import ORACLES, QUERIES
from registry import sources, cleaning, usage, splits, labels, pooling, evaluation, late, models  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
