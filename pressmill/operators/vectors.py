"""Vector columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.functions.vectors import DIMENSIONS, hashed_words


def embed(
    df: DataFrame, text: str = "text", out: str = "embedding", dim: int = DIMENSIONS
) -> DataFrame:
    """Add a hashed bag-of-words vector, all with built-in expressions."""
    return df.withColumn(out, hashed_words(F.col(text), dim))


def embed_with(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], Sequence]],
    text: str = "text",
    out: str = "embedding",
) -> DataFrame:
    """Add vectors from a model of the caller's.

    ``load`` runs once per task and returns a function from a list of texts to
    as many vectors; texts reach it in Arrow batches.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]
    )

    def run(batches):
        import pyarrow as pa

        model = load()
        kind = pa.list_(pa.float32())
        for batch in batches:
            texts = batch.column(text).to_pylist()
            vectors = [[float(x) for x in v] for v in model(texts)] if texts else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(vectors, type=kind)], names=[*batch.schema.names, out]
            )

    return df.mapInArrow(run, schema)
