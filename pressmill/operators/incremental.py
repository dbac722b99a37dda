"""Loads that leave out what is already stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_KEY = ["path", "chunk_no"]


def skip_existing_issues(
    issues: DataFrame,
    stored: DataFrame,
    num: str = "num",
    stored_num: str = "issue_num",
    force_all: bool = False,
) -> DataFrame:
    """Issues of which nothing is stored yet; all of them when forced."""
    if force_all:
        return issues
    known = stored.select(F.col(stored_num).alias(num)).distinct()
    return issues.join(known, num, "left_anti")


def skip_stored_chunks(
    chunks: DataFrame, stored: DataFrame | None, key: list[str] | None = None
) -> DataFrame:
    """Chunks that are new: not stored, and each key once within the batch.

    What is stored leaves before its text is shuffled. Of chunks with one key the
    one with the least hash of all its columns stays, whatever the run. Chunks
    with a NULL in the key could never be told apart again and are left out.
    """
    key = key or CHUNK_KEY
    for name in key:
        chunks = chunks.filter(F.col(name).isNotNull())
    if stored is not None:
        chunks = chunks.join(stored.select(*key), key, "left_anti")
    return first_by_key(chunks, key)


def first_by_key(rows: DataFrame, key: list[str]) -> DataFrame:
    """One whole row per key: that with the least hash of its columns and of which of them are NULL."""
    rest = [name for name in rows.columns if name not in key]
    if not rest:
        return rows.distinct()
    # the hash passes over NULLs, so it is told where they stand
    marks = [F.col(f"`{name}`").isNull() for name in rest]
    digest = F.struct(F.xxhash64(*[F.col(f"`{name}`") for name in rest], *marks), *marks)
    first = F.min_by(F.struct(*rest), digest).alias("_first")
    return rows.groupBy(*key).agg(first).select(*[name if name in key else F.col(f"_first.{name}") for name in rows.columns])
