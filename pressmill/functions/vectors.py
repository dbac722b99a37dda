"""Vectors of texts and distances between vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions.markdown import words
from pressmill.functions.text import let

DIMENSIONS = 64


def bucket(word: Column, dim: int = DIMENSIONS) -> Column:
    """Stable place of a word in the vector, from its digest."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % dim


def hashed_words(text: Column, dim: int = DIMENSIONS) -> Column:
    """Counts of words by bucket, scaled to length one; all zero without words.

    The buckets are written as one string and counted by what removing each
    code takes away, which stays on plain string operations. Up to 90 buckets
    have one-character codes.
    """
    short = dim <= 90
    names = [chr(33 + i) if short else f",{i};" for i in range(dim)]

    def code(place: Column) -> Column:
        return F.char(place + 33) if short else F.concat(F.lit(","), place, F.lit(";"))

    def counts(codes: Column) -> Column:
        return F.transform(
            F.array(*[F.lit(n) for n in names]),
            lambda c: (F.octet_length(codes) - F.octet_length(F.replace(codes, c, F.lit(""))))
            / F.octet_length(c),
        )

    def scaled(values: Column) -> Column:
        norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v))
        return let(
            norm,
            lambda n: F.transform(
                values, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0)).cast("float")
            ),
        )

    codes = F.array_join(F.transform(words(text), lambda w: code(bucket(w, dim))), "")
    return let(let(codes, counts), scaled)


def l2_distance(left: Column, right: Column) -> Column:
    """Euclidean distance of two arrays of numbers, in doubles.

    NULL where either is NULL or holds a NULL, or their lengths differ.
    """
    gaps = F.zip_with(left, right, lambda a, b: a.cast("double") - b.cast("double"))
    total = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v)
    return F.when(F.size(left) == F.size(right), F.sqrt(total))
