"""Operators for preparing training data for language models.

Each module holds one operator with its general interface and a thin query
``opN_<name>``; nothing outside this subpackage imports it.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("mixing", "quality", "chat", "bpe", "sharding", "fingerprints", "warc", "substrings", "jaccard", "secrets", "runs", "alignment", "suffixes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"{__name__}.{m}").ORACLES.items()}
