"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import markdown_chunks, oracles, queries, search, stateful, stored, weighted

MODULES = [search, markdown_chunks, weighted, stateful, stored]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return queries.all_queries() | {query.__name__: query for module in MODULES for query in module.QUERIES}


def all_oracles() -> dict[str, str]:
    found = oracles.all_oracles()
    for module in MODULES:
        found |= module.ORACLES
    return found
