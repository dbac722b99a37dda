"""From questions to prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pressmill.functions.vectors import DIMENSIONS
from pressmill.operators.nearest import K, nearest
from pressmill.operators.retrieval import with_context, with_prompts
from pressmill.operators.vectors import embed


def ask(
    queries: DataFrame, index: DataFrame, k: int = K, dim: int = DIMENSIONS
) -> DataFrame:
    """Context and prompts of each ``(query_id, query)`` against a vector table.

    ``index`` is read by the search and again for the texts of the hits: a stored
    table, as ``append_documents`` writes it, saves making its vectors twice.
    """
    asked = embed(queries, "query", "query_vec", dim)
    hits = nearest(asked, index, k, dim=dim)
    return with_prompts(with_context(queries, hits, index, k=k))
