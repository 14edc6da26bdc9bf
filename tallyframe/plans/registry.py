"""Queries by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.facts import FACT_ROWS_SQL, FACTS_SQL, LEGAL_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``{facts}``, ``{rows}`` and ``{legal}`` stand for the views' SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{facts}", f"({FACTS_SQL})").replace("{rows}", f"({FACT_ROWS_SQL})").replace("{legal}", f"({LEGAL_SQL})")
        return f

    return add
