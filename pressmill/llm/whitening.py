"""Embeddings whitened by the principal components of their covariance.

Moments are summed by the tasks that hold the vectors and reach the driver as one
number per dimension or pair of dimensions; the components of the covariance are
found there by contour integration (``feast``) and sent along with the last pass.
Entries are scaled to integers first, so that counts, sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import frozen, only, record_batch
from pressmill.llm.feast import largest_pairs

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this don't fit the integers; their rows are left out like those of infinite entries.
LARGEST = float(1 << 55)
ROWS = 2048


@dataclass(frozen=True)
class Fit:
    """What a pass over the vectors needs: their number, exact sums, and the components found."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Integer vectors less the mean, which is taken off as an integer and a fraction."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        part = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(float) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n x - S) squared; None where that is no 64-bit integer."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        part = np.array([s % self.n for s in self.sums], dtype=np.int64)
        away = x - whole
        reach = (float(np.abs(away).max(initial=0)) + 1) * self.n
        if reach**2 * max(1, x.shape[1]) < 2.0**62:
            return ((away * self.n - part) ** 2).sum(axis=1).tolist()
        exact = [sum((int(a) * self.n - int(p)) ** 2 for a, p in zip(row, part, strict=True)) for row in away]
        return [value if value < 1 << 63 else None for value in exact]


def _usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and they are finite."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry)


def usable_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` (a long) and ``x`` (integers, 8 bytes each) of the rows that are whitened, as a written table.

    Vectors that are NULL, empty or hold NULL, NaN, infinite or too large entries
    are left out, and so are those of another length than most (of equally common
    lengths the longest counts).
    """
    found = only(rows, key, vector).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    schema = pa.schema([("key", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                lists = part.column(1)
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
                x = np.floor(SCALE * values).astype("<i8") + OFFSET
                ends = lists.offsets.to_numpy()
                ends = (8 * (ends - ends[0])).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(x)])
                yield pa.RecordBatch.from_arrays([part.column(0), packed], schema=schema)

    scaled = frozen(found.filter(_usable(F.col("vector"))).mapInArrow(run, "key long, x binary"))
    size = F.octet_length("x")
    most = scaled.groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return scaled.filter(size == (most["size"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a column of equally long ones as integers, a row each."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    x = np.frombuffer(column.buffers()[2], "<i8", (int(ends[-1]) - int(ends[0])) // 8, int(ends[0]))
    return x.reshape(len(column), -1)


def _summed(vectors: DataFrame, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all vectors of a table of numbers that ``sums`` makes of some; None of no vectors.

    Tasks add up what they hold. Their tables are added by Spark, entry by entry.
    """
    schema = pa.schema([("row", pa.int32()), ("entries", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = np.atleast_2d(sums(_matrix(batch.column(1))))
                total = found if total is None else total + found
        if total is not None:
            yield record_batch(schema, [np.arange(len(total), dtype=np.int32), list(total)])

    tables = vectors.mapInArrow(run, "row int, entries array<double>")
    entries = tables.select("row", F.posexplode("entries").alias("at", "entry"))
    found = entries.groupBy("row", "at").agg(F.sum("entry").alias("entry")).collect()  # as many as the table has
    if not found:
        return None
    out = np.zeros((max(r["row"] for r in found) + 1, max(r["at"] for r in found) + 1))
    for r in found:
        out[r["row"], r["at"]] = r["entry"]
    return out


def _exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension of the scaled integers."""
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                n += len(x)
                high = high + (x >> 32).sum(axis=0)
                low = low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield record_batch(schema, [np.arange(len(high), dtype=np.int32), np.full(len(high), n), high, low])

    big = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    tables = vectors.mapInArrow(run, "at int, n long, high long, low long")
    found = sorted(tables.groupBy("at").agg(F.sum("n").alias("n"), big("high"), big("low")).collect())  # a row per dimension
    return (found[0]["n"] if found else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of the covariance of ``vectors`` (see ``usable_vectors``); None of no vectors or ones that are all equal.

    Two passes: exact sums, then products of centred vectors.
    """
    n, sums = _exact_sums(vectors)
    if not n:
        return None
    none = Fit(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        y = none.centred(x)
        return y.T @ y

    covariance = _summed(vectors, products) / n
    values, pairs = largest_pairs((covariance + covariance.T) / 2, components)
    return Fit(n, sums, values, pairs, float(np.trace(covariance))) if len(values) else None


def identity_error(vectors: DataFrame, found: Fit) -> float:
    """Largest entry of the covariance of the whitened vectors less the identity, measured on all of them."""
    mean = _summed(vectors, lambda x: found.whitened(x).sum(axis=0))[0] / found.n

    def products(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x) - mean
        return w.T @ w

    covariance = _summed(vectors, products) / found.n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whitened_vectors(rows: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """``key`` and ``whitened`` (an array of doubles) of every usable row, by components fitted on all of them."""
    vectors = usable_vectors(rows, key, vector)
    found = fit(vectors, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found is not None and batch.num_rows:
                schema = pa.schema([(key, pa.int64()), ("whitened", pa.list_(pa.float64()))])
                yield record_batch(schema, [batch.column(0), list(found.whitened(_matrix(batch.column(1))))])

    return vectors.mapInArrow(run, f"`{key}` long, whitened array<double>")


COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_components(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of ``rows`` and component, see ``COLUMNS``; other columns are ignored.

    Rows are left out as in ``usable_vectors``. A NULL key is kept, repeated rows
    count and come out as often as they are there. Components without variance
    aren't returned, so that an empty table, one row, or rows that are all equal
    give none. Equal eigenvalues are numbered in the order they were found.
    ``deviation`` is NULL where the exact number is beyond 64 bits.
    """
    vectors = usable_vectors(rows, key, vector)
    found = fit(vectors, components)
    error = identity_error(vectors, found) if found else 0.0
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(found.values)
        share = found.values / found.trace
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x, size = _matrix(part.column(1)), part.num_rows
                each = pa.array(np.repeat(np.arange(size), width))
                yield record_batch(
                    schema,
                    [
                        part.column(0).take(each),
                        np.tile(np.arange(1, width + 1, dtype=np.int32), size),
                        np.full(size * width, found.n),
                        pa.array(found.deviations(x), pa.int64()).take(each),
                        found.whitened(x).ravel(),
                        np.tile(share, size),
                        np.full(size * width, error),
                    ],
                )

    if found is None:
        return vectors.sparkSession.createDataFrame([], COLUMNS)
    return vectors.mapInArrow(run, COLUMNS)
