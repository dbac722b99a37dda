"""Counts that a run reports about its stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Observation


def count_by(df: DataFrame, stage: str, *keys: str) -> DataFrame:
    """Rows per key of a stage: chunks per document, hits per query, and so on."""
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return (
        df.groupBy(name.alias("item"))
        .agg(F.count("*").alias("n"))
        .select(F.lit(stage).alias("stage"), "item", "n")
    )


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """The same rows, counted while they pass to whatever action follows."""
    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
