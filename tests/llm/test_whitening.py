"""Eigenpairs against numpy's, and whitened rows against a computation by plain numpy."""

import numpy as np
import pytest

from pressmill.llm import feast, whitening


def symmetric(values, seed=0):
    turned, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return turned * np.array(values) @ turned.T


CASES = {
    "spread": np.linspace(1, 50, 64),
    "steep": 2.0 ** -np.arange(40),
    "close": 10 + 1e-7 * np.arange(30),
    "equal": [3.0] * 20,
    "few ranks": [5.0, 4.0, 4.0, 1.0] + [0.0] * 30,
    "one": [7.0],
    "two groups": [100.0] * 12 + [1.0] * 12,
    "nothing": [0.0] * 5,
}


@pytest.mark.parametrize("name", CASES)
def test_largest_pairs(name):
    matrix = symmetric(CASES[name])
    scale = max(1e-300, np.abs(matrix).sum(axis=1).max())
    for count in (1, 7, 32):
        want = np.sort(np.linalg.eigvalsh(matrix))[::-1]
        want = want[: min(count, int((want > len(want) * 2e-15 * scale).sum()))]
        values, vectors = feast.largest_pairs(matrix, count)
        assert len(values) == len(want) and np.abs(values - want).max(initial=0) < 1e-13 * scale
        assert np.abs(matrix @ vectors - vectors * values).max(initial=0) < 1e-13 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-12


def test_inertia_counts():
    for name, values in CASES.items():
        matrix = symmetric(values, 3)
        for shift in (-1.0, 0.5, 3.5, 20.0, 101.0):
            assert feast.negatives(matrix - shift * np.eye(len(matrix))) == int((np.array(values) < shift).sum()), name
    assert feast.negatives(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1 and feast.negatives(np.zeros((3, 3))) == 0


def given():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((700, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] @ symmetric(np.ones(6), 2)
    rows = [(n, [float(x) for x in v], "k") for n, v in enumerate(base)]
    rows += [(3, rows[3][1], "twice"), (None, rows[4][1], "no id"), (800, None, ""), (801, [], ""), (802, [1.0] * 5 + [None], "")]
    rows += [(803, [float("nan")] * 6, ""), (804, [float("inf")] * 6, ""), (805, [1.0] * 5, ""), (806, [1e300] * 6, "")]
    return rows, 702


def test_rows(spark):
    rows, usable = given()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(5)
    got = whitening.whitened_components(df, components=4).collect()
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v, _ in rows[:usable]])
    n, sums = len(x), x.sum(axis=0)
    covariance = np.cov((x - sums / n).T, bias=True)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    want = {}
    for (key, *_), row in zip(rows[:usable], x, strict=True):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))
        want.setdefault(key, []).append((deviation, (row - sums / n) @ vectors / np.sqrt(values)))
    assert len(got) == 4 * usable and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    signs = {}
    for r in got:
        deviation, scores = min(want[r.vec_id], key=lambda one: abs(one[0] - r.deviation))
        assert r.deviation == deviation
        assert abs(r.explained - values[r.component - 1] / np.trace(covariance)) < 1e-10
        assert abs(abs(r.whitened) - abs(scores[r.component - 1])) < 1e-8
        if abs(r.whitened) > 1e-6:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened) * np.sign(scores[r.component - 1]))
    assert all(len(one) == 1 for one in signs.values()) and len(signs) == 4
    wide = whitening.whitened_vectors(df, "vec_id", "embedding", 4).collect()
    assert sorted(x for r in wide for x in r.whitened) == pytest.approx(sorted(r.whitened for r in got))


def test_large_numbers_are_exact(spark):
    rows = [(n, [float(2**50 * n), -1.0]) for n in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened_components(df).collect()
    assert {r.deviation for r in got} == {None} and {r.component for r in got} == {1}
    rows = [(n, [float(2**20 * n), -1.0]) for n in range(4)]
    got = whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in got} == {n: (4 * n * 2**26 - 6 * 2**26) ** 2 for n in range(4)}


def test_nothing_to_whiten(spark):
    shape = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        found = whitening.whitened_components(spark.createDataFrame(rows, shape))
        assert found.collect() == [] and len(found.columns) == 7
        assert whitening.whitened_vectors(spark.createDataFrame(rows, shape), "vec_id", "embedding").collect() == []
