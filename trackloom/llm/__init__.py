"""Operators for preparing language-model training text, their queries and the SQL these are checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("tool_calls", "line_rules", "prob_minhash", "repeat_intervals", "relative_lz", "templates", "toxicity", "discriminant", "entropy_scan",
           "mixing", "filter_audit", "lexical_search", "url_filter")


def load() -> None:
    """Fill ``QUERIES`` and ``ORACLES`` from the operator modules."""
    for name in MODULES:
        import_module(f"trackloom.llm.{name}")
