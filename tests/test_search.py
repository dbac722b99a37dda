"""Searches by hashed projections and by a stored index, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.functions.vectors import l2_distance
from pressmill.operators import hashed
from pressmill.operators.cell_index import CellIndex

SHAPE = "vec_id long, embedding array<float>"


def clusters(count, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    return (centres[rng.integers(0, 8, count)] + spread * rng.standard_normal((count, dim))).astype("float32")


def exact(asked, stored, k):
    out = {}
    for q, a in asked:
        gaps = sorted((float(np.sqrt(((a.astype(float) - b.astype(float)) ** 2).sum())), v) for v, b in stored)
        out[q] = [(v, round(gap, 6)) for gap, v in gaps[:k]]
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], SHAPE).repartition(parts)


def queries(df):
    return df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def shown(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.distance, 6)))
    return out


def test_hashed_search_finds_what_shares_a_bucket(spark):
    rows = list(enumerate(clusters(400, 12, 1)))
    df = frame(spark, rows)
    all_buckets = hashed.nearest_hashed(queries(df), df, k=3, tables=2, bits=4, probes=16)
    assert shown(all_buckets) == exact(rows, rows, 3)
    few = shown(hashed.nearest_hashed(queries(df), df, k=3, tables=6, bits=5, probes=6))
    want = exact(rows, rows, 3)
    assert sum(len(set(few[q]) & set(want[q])) for q in want) >= 0.9 * 3 * len(want)


def test_copies_are_split_over_slices(spark):
    rng = np.random.default_rng(3)
    one = rng.standard_normal(8).astype("float32")
    rows = [(n, one) for n in range(900)] + [(n, rng.standard_normal(8).astype("float32")) for n in range(900, 1000)]
    df = frame(spark, rows)
    asked = queries(df.filter("vec_id % 100 = 0 or vec_id > 950"))
    got = shown(hashed.nearest_hashed(asked, df, tables=3, bits=3, probes=8, rows_per_slice=50))
    assert got == exact([row for row in rows if row[0] % 100 == 0 or row[0] > 950], rows, 4)


def test_buckets_and_probes_by_rule():
    made = hashed.Hashing(2, 4, [3, -5, 0])
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((20, 3))
    normals = hashed.planes(2, 4, 3)
    for row, (own, probed) in enumerate(zip(made.buckets(vectors), made.probed(vectors, 5), strict=True)):
        for table in range(2):
            side = [sum(int(a) * (int(np.floor(x * hashed.GRAIN)) - m) for a, x, m in zip(normals[table][b], vectors[row], [3, -5, 0], strict=True)) for b in range(4)]
            assert own[table] == sum(1 << b for b in range(4) if side[b] > 0)
            cost = {bucket: sum(abs(side[b]) for b in range(4) if (bucket >> b & 1) != (side[b] > 0)) for bucket in range(16)}
            assert probed[table].tolist() == sorted(cost, key=lambda bucket: (cost[bucket], bucket))[:5]


def test_unsound_and_missing_vectors(spark, tmp_path):
    good = list(enumerate(clusters(30, 5, 2)))
    bad = [(100, None), (101, [1.0, 2.0]), (102, [float("nan")] * 5), (103, [None, 1.0, 1.0, 1.0, 1.0])]
    df, empty = frame(spark, good + bad), frame(spark, [])
    assert shown(hashed.nearest_hashed(queries(df), df, tables=2, bits=2, probes=4)) == exact(good, good, 4)
    assert hashed.nearest_hashed(queries(df), empty).collect() == [] and hashed.nearest_hashed(queries(empty), df).collect() == []
    index = CellIndex.create(df, str(tmp_path / "some"), cells=4)
    assert shown(index.nearest(queries(df))) == exact(good, good, 4)
    none = CellIndex.create(empty, str(tmp_path / "none"))
    none.append(df, "later")
    assert none.nearest(queries(df)).collect() == []


def test_stored_index_is_exact_over_loads(spark, tmp_path):
    rows = list(enumerate(clusters(700, 10, 5)))
    rows += [(2000 + n, rows[7][1]) for n in range(300)]
    df = frame(spark, rows)
    path = str(tmp_path / "index")
    index = CellIndex.create(df.filter("vec_id < 300"), path, cells=12)
    for _ in range(2):  # a load that is run again replaces itself
        index.append(df.filter("vec_id >= 300"), "more")
    again = CellIndex(spark, path)
    assert again.vectors().count() == len(rows)
    asked = [row for row in rows if row[0] % 13 == 0]
    for k in (1, 4, 30):
        got = again.nearest(queries(df.filter("vec_id % 13 = 0")), k)
        assert shown(got) == exact(asked, rows, k)
    assert shown(again.nearest(queries(df.filter("vec_id % 13 = 0")), shipped=5)) == exact(asked, rows, 4)


def test_a_load_cut_off_before_its_counts_stays_exact(spark, tmp_path):
    rows = list(enumerate(clusters(200, 6, 6)))
    df = frame(spark, rows)
    index = CellIndex.create(df.filter("vec_id < 100"), str(tmp_path / "index"), cells=5)
    save = index._save
    index._save = lambda rows, name, load, *by: None if name == "held" else save(rows, name, load, *by)
    index.append(df.filter("vec_id >= 100"), "cut off")
    assert shown(index.nearest(queries(df))) == exact(rows, rows, 4)


def test_a_search_reads_its_cells_and_shuffles_no_vector(spark, tmp_path):
    df = frame(spark, list(enumerate(clusters(600, 6, 7, 0.05))))
    index = CellIndex.create(df, str(tmp_path / "index"), cells=8)
    hits = index.nearest(queries(df.filter("vec_id = 5")))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")  # of hits, above the scan
    held = {r.cell for r in index.vectors().select("cell").distinct().collect()}
    asked = np.array([df.filter("vec_id = 5").first().embedding])
    wanted = np.flatnonzero(index._wanted(asked, index.centroids(), index.bounds(4))[0])
    assert 0 < len(wanted) < len(held)
    assert "PartitionFilters: [" in plan and "cell" in plan[plan.index("PartitionFilters") :][:200]


def test_distance(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([None], [1.0]), ([], [])], "a array<float>, b array<float>")
    got = [r.d for r in df.select(l2_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [5.0, None, None, None, 0.0]


def test_recall(spark):
    some = spark.createDataFrame([(1, 2), (1, 3)], "query_id int, vec_id int")
    rest = spark.createDataFrame([(1, 2), (1, 4), (2, 2)], "query_id int, vec_id int")
    assert tuple(hashed.recall(some, rest).first()) == (3, 1, pytest.approx(1 / 3, abs=1e-6))
