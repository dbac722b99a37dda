"""A stored index of vectors, in folders by cell, for exact searches that read few of them.

Cells are the neighbourhoods of centroids, which rounds of k-means over all vectors
move to where the vectors are. The index is a folder with

* ``centroids``: the centroid of every cell;
* ``vectors``: the vectors, partitioned by load and cell;
* ``reach`` and ``held``: per load and cell the greatest distance of a vector from its
  centroid; how many there are, and the least distances.

A search finds from these which cells may hold one of the nearest vectors of a query
(by the triangle inequality, so the result is exact), reads their partitions alone,
and takes the queries to the vectors: no vector is shuffled. Loads may be added at
any time. ``reach`` is written before the vectors and ``held`` after them, so a load
that was cut off can widen a search, never falsify it; run again it replaces itself.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.operators.nearest import (
    K,
    SHIPPED_QUERIES,
    SHIPPED_VALUES,
    _hit_schema,
    _kernel,
    _placing,
    common_dimension,
    nearest_by_cells,
    rank_hits,
    usable,
)
from pressmill.session import frozen
from pressmill.sources.tables import read_table

ROUNDS = 3
MOST_CELLS = 4096
#: Least distances kept per load and cell: searches for more hits than these look into whole cells.
KEPT = 16


def start_points(stored: DataFrame, key: str, vec: str, cells: int) -> np.ndarray:
    """Different vectors to begin with: those with the least digests of their keys."""
    chosen = stored.orderBy(F.md5(F.col(key).cast("string")), key).limit(cells).select(vec).toArrow()
    return np.unique(np.array(chosen.column(0).to_pylist(), dtype="float64"), axis=0)


def moved_points(stored: DataFrame, vec: str, points: np.ndarray) -> np.ndarray:
    """The mean of the vectors of every cell, summed by the tasks that hold them; empty cells stay where they are."""
    spark = stored.sparkSession
    shipped, place = spark.sparkContext.broadcast(points), _placing()
    matrix, _, _ = _kernel(1)

    def run(batches):
        import pyarrow as pa

        count, sums = np.zeros(len(shipped.value), "int64"), np.zeros(shipped.value.shape)
        for batch in batches:
            if batch.num_rows:
                cell, _ = place(batch.column(0), shipped.value)
                np.add.at(count, cell, 1)
                np.add.at(sums, cell, matrix(batch.column(0)))
        used = count.nonzero()[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype("int32")), pa.array(count[used]), pa.array(list(sums[used]), pa.list_(pa.float64()))],
            names=["cell", "n", "total"],
        )

    parts = stored.select(vec).mapInArrow(run, "cell int, n long, total array<double>")
    entries = parts.select("cell", "n", F.posexplode("total").alias("at", "x"))
    means = entries.groupBy("cell", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    found = points.copy()
    for row in means.collect():  # as many as the centroids have coordinates
        found[row["cell"], row["at"]] = row["x"]
    return found


class CellIndex:
    """An index at ``path``; made by ``create``, opened by its path alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(
        cls, vectors: DataFrame, path: str, key: str = "vec_id", vec: str = "embedding", cells: int | None = None, rounds: int = ROUNDS, dim: int | None = None
    ) -> CellIndex:
        """Centroids of ``vectors`` and their first load.

        ``cells`` is by default near the root of the number of vectors, at most
        ``MOST_CELLS``; centroids together hold at most ``SHIPPED_VALUES`` numbers.
        Vectors are left out as in ``nearest``; without any the index is empty and
        has no cells.
        """
        dim = dim or common_dimension(vectors, vec)
        stored = usable(vectors.select(key, vec), vec, dim)
        cells = cells or min(MOST_CELLS, max(1, math.isqrt(stored.count())))
        points = start_points(stored, key, vec, min(cells, max(1, SHIPPED_VALUES // max(dim, 1))))
        for _ in range(rounds if len(points) else 0):
            points = moved_points(stored, vec, points)
        found = cls(vectors.sparkSession, path)
        rows = [(n, dim, [float(x) for x in point]) for n, point in enumerate(points)]
        made = found.spark.createDataFrame(rows, "cell int, dim int, centroid array<double>")
        made.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        found.append(vectors, "first", key, vec)
        return found

    def centroids(self) -> np.ndarray:
        rows = sorted(self.spark.read.parquet(f"{self.path}/centroids").select("cell", "centroid").collect())
        return np.array([row["centroid"] for row in rows], dtype="float64")

    def append(self, vectors: DataFrame, load: str, key: str = "vec_id", vec: str = "embedding") -> None:
        """Adds the vectors under the name of a load; a load of that name replaces what it wrote before.

        Keys become longs or strings as they are; a load's rows with vectors of
        another length than the index's, or unsound ones, are left out.
        """
        points = self.centroids()
        if not len(points):
            return
        stored = usable(vectors.select(F.col(key).alias("vec_id"), F.col(vec).alias("embedding")), "embedding", points.shape[1])
        placed = frozen(self._placed(stored, points))
        by_cell = placed.groupBy("cell")
        reach = by_cell.agg(F.max("radius").alias("far"))
        self._save(reach, "reach", load)
        rebalanced = placed.hint("rebalance", "cell")
        self._save(rebalanced, "vectors", load, "cell")
        self._save(self._nearest_radii(placed), "held", load)

    def _placed(self, stored: DataFrame, points: np.ndarray) -> DataFrame:
        shipped, place = self.spark.sparkContext.broadcast(points), _placing()
        schema = T.StructType([*stored.schema.fields, T.StructField("radius", T.DoubleType()), T.StructField("cell", T.IntegerType())])

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                cell, radius = place(batch.column(1), shipped.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(radius), pa.array(cell)], names=[*batch.schema.names, "radius", "cell"])

        return stored.mapInArrow(run, schema)

    def _nearest_radii(self, placed: DataFrame) -> DataFrame:
        """Number of vectors and the ``KEPT`` least radii of each cell; a task brings no more of either."""

        def run(batches):
            import pyarrow as pa

            count: dict[int, int] = {}
            near: dict[int, np.ndarray] = {}
            for batch in batches:
                cells, radii = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for cell in np.unique(cells).tolist():
                    own = radii[cells == cell]
                    count[cell] = count.get(cell, 0) + len(own)
                    near[cell] = np.sort(np.concatenate([near.get(cell, np.zeros(0)), own]))[:KEPT]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(count), pa.int32()),
                    pa.array(list(count.values()), pa.int64()),
                    pa.array([near[cell].tolist() for cell in count], pa.list_(pa.float64())),
                ],
                names=["cell", "n", "near"],
            )

        parts = placed.select("cell", "radius").mapInArrow(run, "cell int, n long, near array<double>")
        radii = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, KEPT)
        return parts.groupBy("cell").agg(F.sum("n").alias("n"), radii.alias("near"))

    def _save(self, rows: DataFrame, name: str, load: str, *by: str) -> None:
        (
            rows.withColumn("load", F.lit(load))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("load", *by)
            .parquet(f"{self.path}/{name}")
        )

    def vectors(self) -> DataFrame | None:
        """All that is stored: ``vec_id``, ``embedding``, ``radius``, ``load`` and ``cell``."""
        return read_table(self.spark, f"{self.path}/vectors")

    def bounds(self, k: int) -> dict[int, tuple[float, float]]:
        """Per cell its greatest radius and one that ``k`` of its vectors don't exceed (infinite: not known)."""
        reach, held = read_table(self.spark, f"{self.path}/reach"), read_table(self.spark, f"{self.path}/held")
        if reach is None or held is None:
            return {}
        far = reach.groupBy("cell").agg(F.max("far").alias("far"))
        n = held.groupBy("cell").agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
        rows = far.join(n, "cell", "left").collect()  # a row per cell

        def kth(row) -> float:
            if (row["n"] or 0) < k:
                return math.inf
            return row["near"][k - 1] if k <= KEPT else row["far"]

        return {row["cell"]: (row["far"], kth(row)) for row in rows}

    def nearest(
        self, queries: DataFrame, k: int = K, query_id: str = "query_id", query_vec: str = "query_vec", shipped: int = SHIPPED_QUERIES
    ) -> DataFrame:
        """The ``k`` nearest stored vectors of each query, ranked from 1, exactly.

        Queries are left out as in ``nearest``. Up to ``shipped`` queries (and
        ``SHIPPED_VALUES`` numbers) go to the tasks that read the cells they may
        have hits in; beyond that both sides meet by cell.
        """
        points, stored = self.centroids(), self.vectors()
        dim = points.shape[1] if len(points) else 0
        asked = usable(queries.select(query_id, query_vec), query_vec, dim)
        none = self.spark.createDataFrame([], "vec_id long, embedding array<float>")
        held = none if stored is None else stored.select("vec_id", "embedding")
        schema = _hit_schema(queries, held, query_id, "vec_id")
        if stored is None:
            return rank_hits(self.spark.createDataFrame([], schema), query_id, "vec_id", k)
        limit = max(1, min(shipped, SHIPPED_VALUES // max(dim, 1)))
        head = asked.limit(limit + 1).toArrow()
        if len(head) > limit:
            return nearest_by_cells(queries, held, k, query_id, query_vec, dim=dim)
        ids, block = head.column(0).combine_chunks(), np.array(head.column(1).to_pylist(), dtype="float64").reshape(len(head), dim)
        wanted = self._wanted(block, points, self.bounds(k))
        cells = np.flatnonzero(wanted.any(axis=0)).tolist()
        table = self.spark.sparkContext.broadcast((ids, block, wanted))
        matrix, ranks, search = _kernel(k)

        def scan(batches):
            import pyarrow as pa

            names, asking, visits = table.value
            best = np.full(len(asking), np.inf)
            for batch in batches:
                vectors, place, of = matrix(batch.column(1)), ranks(batch.column(0)), batch.column(2).to_numpy()
                for cell in np.unique(of).tolist():
                    rows, own = np.flatnonzero(of == cell), np.flatnonzero(visits[:, cell])
                    if not len(own):
                        continue
                    limits = best[own]
                    cols, found, gaps = search(vectors[rows], place[rows], asking[own], limits)
                    best[own] = limits
                    taken = pa.array(own[cols])
                    yield pa.RecordBatch.from_arrays(
                        [names.take(taken), batch.column(0).take(pa.array(rows[found])), pa.array(gaps)], names=[query_id, "vec_id", "distance"]
                    )

        read = stored.filter(F.col("cell").isin(cells)).select("vec_id", "embedding", "cell")
        return rank_hits(read.mapInArrow(scan, schema), query_id, "vec_id", k)

    @staticmethod
    def _wanted(block: np.ndarray, points: np.ndarray, bounds: dict[int, tuple[float, float]]) -> np.ndarray:
        """By query and cell, whether one of the nearest may be there."""
        wanted = np.zeros((len(block), len(points)), dtype=bool)
        used = np.array(sorted(bounds), dtype="int64")
        if not len(used) or not len(block):
            return wanted
        far, kth = (np.array([bounds[cell][n] for cell in used.tolist()]) for n in (0, 1))
        for start in range(0, len(block), 64):
            part = block[start : start + 64]
            away = np.sqrt(((part[:, None, :] - points[None, used, :]) ** 2).sum(axis=2))
            reach = (away + kth).min(axis=1)
            wanted[start : start + 64, used] = away - far <= (reach * (1 + 1e-9) + 1e-9)[:, None]
        return wanted
