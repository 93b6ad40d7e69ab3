"""All registered queries and the SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name, with its SQL twin where there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


from lodestar.plans import claims, derive, fusion, imports, queue, resolve, similarity, stats, streams, texts, timeline  # noqa: E402, F401  (each registers its queries)
