"""What several of the operators share: keys, written tables and Arrow columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.session import frozen, released

__all__ = ["ascii_lower", "column_bytes", "crc_remainder", "fresh", "frozen", "only", "record_batch", "released"]


def crc_remainder(key: Column, modulus: int) -> Column:
    """``crc32`` of a key written as text, modulo ``modulus``; NULL keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z only, whatever the letters around them."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, NULL as the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """Columns as a batch of the given schema."""
    return pa.RecordBatch.from_arrays(
        [
            column if isinstance(column, pa.Array) else pa.array(column, type=field.type)
            for column, field in zip(columns, schema, strict=True)
        ],
        schema=schema,
    )


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that others can't clash with what is added."""
    return df.select(*[F.col(name) for name in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet, made from the given ones."""
    taken = {name.lower() for name in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        found.append(name)
    return found
