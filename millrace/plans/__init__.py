"""All queries of the library but those of the llm subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import answers, archive, bank, cache, crawl, edits, eligibility, flows, health, identity, imports, index, links, nodes, pages, questions, refresh, retrieve, store, upkeep
from ..sources import views
from ..streaming import framing

_MODULES = (retrieve, eligibility, store, edits, imports, pages, questions, answers, links, health, upkeep, flows, bank, refresh, index, crawl, archive, nodes, cache, framing, identity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of each query that SQL can express, the views of the model in front."""

    def whole(sql: str) -> str:
        rest = sql.strip()
        kind = "WITH RECURSIVE " if rest.startswith("WITH RECURSIVE ") else "WITH "
        own = ", " + rest[len(kind) :] if rest.startswith(kind) else "\n" + rest
        return f"{kind}{views.SQL.strip()}{own}"

    return {name: whole(sql) for m in _MODULES for name, sql in m.ORACLES.items()}
