"""Names every query of the library outside ``llm`` and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import analytics, cleaning, governance, index, listings, pages, reads, records, stores, streams

_PLANS = (index, cleaning, analytics, governance, reads, records, pages, streams, listings, stores)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.ORACLE.items()}
