"""Contexts and prompts for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.operators.nearest import K

# The texts a chat model is given.
SYSTEM_PROMPT = """You are a helpful assistant that answers questions based on provided context. Follow these guidelines:

1. PRIORITIZE the provided context over your general knowledge
2. If the context contains relevant information, base your answer primarily on it
3. If the context doesn't contain enough information to answer the question, use your general knowledge
4. Give comprehensive and detailed answer to the original question
5. If you refer to a source text, article, or author, mention the name of the source or omit it if you don't know
6. Combine information from multiple sources when neccessary"""
PROMPT_CONTEXT = "Context:\n"
PROMPT_QUESTION = "\n\nQuestion: "
PROMPT_CLOSING = "\n\nPlease answer the question based primarily on the provided context"


def with_context(
    queries: DataFrame,
    hits: DataFrame,
    chunks: DataFrame,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    text: str = "text",
    k: int = K,
) -> DataFrame:
    """Add the texts of each query's first ``k`` hits in rank order; '' without any.

    Hits carry keys only, so the texts are joined after the ranking and no list
    outgrows ``k``. Hits of other queries are left out first; whether the others
    are small enough to be sent to the chunks is for adaptive execution to see.
    """
    keys = hits.filter(F.col("rank") <= k).select(query_id, vector_id, "rank")
    keys = keys.join(queries.select(query_id).distinct(), query_id, "left_semi")
    found = chunks.select(vector_id, F.col(text).alias("_text")).join(keys, vector_id)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "_text")))
    contexts = found.groupBy(query_id).agg(
        F.array_join(F.transform(ordered, lambda h: h["_text"]), "\n\n").alias("context")
    )
    return queries.join(contexts, query_id, "left").withColumn(
        "context", F.coalesce("context", F.lit(""))
    )


def with_prompts(questions: DataFrame, query: str = "query") -> DataFrame:
    """Add the system and user prompts of each question and its context."""
    user = F.concat(
        F.lit(PROMPT_CONTEXT), F.col("context"), F.lit(PROMPT_QUESTION), F.col(query),
        F.lit(PROMPT_CLOSING),
    )
    return questions.withColumns({"system_prompt": F.lit(SYSTEM_PROMPT), "user_prompt": user})
