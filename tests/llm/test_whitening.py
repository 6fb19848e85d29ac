"""Whitening against plain numpy, the solver against numpy's, odd vectors, and the digest's exact numbers."""

import math

import numpy as np
import pytest

from engram.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int"


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("shape", [(5, 1), (30, 7), (200, 40), (9, 20), (64, 64)])
def test_solver(seed, shape):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal(shape) * np.geomspace(1, 10.0 ** -(seed * 1.5), shape[1])
    n, d = shape
    values, directions, explained = whitening.solve(np.linalg.qr(rows, mode="r"), n, min(16, d))
    want = np.zeros(d)
    singular = np.linalg.svd(rows, compute_uv=False)
    want[: len(singular)] = singular**2 / n
    k = len(values)
    assert np.allclose(values, want[:k], rtol=1e-12, atol=want[0] * 1e-15)
    assert np.allclose(directions.T @ directions, np.eye(k), atol=1e-12)
    covariance = rows.T @ rows / n
    assert np.abs(covariance @ directions - directions * values).max() < 1e-13 * want[0] * d
    assert np.allclose(explained, values / np.trace(covariance), rtol=1e-12)


@pytest.mark.parametrize(
    "matrix",
    [np.eye(12), np.diag([3.0, 3, 3, 2, 2, 1, 0, 0]), np.ones((6, 6)), np.zeros((4, 4)), np.triu(np.ones((9, 9))), np.diag([1.0, 1 + 1e-15, 1 - 1e-15, 1 + 1e-9, 0.5]), np.diag([1e-9, 1.0, 1e-3])],
)
def test_solver_with_equal_and_missing_values(matrix):
    values, directions, _ = whitening.solve(np.linalg.qr(matrix, mode="r"), 1, 16)
    square = matrix.T @ matrix
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(square))[::-1][: len(values)], atol=1e-14 * max(1, np.trace(square)))
    assert np.allclose(directions.T @ directions, np.eye(len(values)), atol=1e-12)
    assert np.abs(square @ directions - directions * values).max() <= 1e-13 * max(1, np.trace(square))


def test_small_singular_values_are_accurate():
    """Of a graded bidiagonal even the least value has all its digits."""
    from fractions import Fraction

    a, b = 10.0 ** -np.arange(0, 24, 3), 10.0 ** -np.arange(1, 22, 3)
    found = whitening.squared_singular_values(a, b)
    product = math.prod(Fraction(x) ** 2 for x in a)
    assert math.isclose(math.prod(Fraction(float(x)) for x in found) / product, 1, rel_tol=1e-12)


def brute(rows, components=16):
    """{row index: (n, deviation, whitened, explained)} and the distinct x, from plain Python sums."""
    kept = [(i, [math.floor(64 * c) + 1000000 for c in map(float, v)]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        at = np.array([(n * c - s) / n for c, s in zip(x, sums)])
        out.append((i, n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), at @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", 1) for i, v in rows], SCHEMA)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((20, 20)) * np.geomspace(1, 0.05, 20)
    good = [(k, [float(np.float32(c)) for c in rng.standard_normal(20) @ mix]) for k in range(300)]
    good += [(300 + k, v) for k, (_, v) in enumerate(good[:40])] + [(None, good[0][1]), (5, good[5][1])]
    bad = [(900, None), (901, []), (902, [None] * 20), (903, [float("nan")] + [0.0] * 19), (904, [float("inf")] * 20)]
    got = {}
    for r in whitening.whiten(frame(spark, good + bad).repartition(7)).collect():
        got.setdefault((r["vec_id"]), []).append(r)
    want = {}
    for one in brute(good):
        want.setdefault(one[0], []).append(one)
    assert set(got) == set(want)
    signs = None
    for i, rows in want.items():
        found = sorted(got[i], key=lambda r: r["component"])
        assert len(found) == 16 * len(rows)
        for _, n, deviation, white, explained in rows:
            mine = found[:: len(rows)]
            assert [r["component"] for r in mine] == list(range(1, 17))
            assert {(r["n"], r["deviation"]) for r in mine} == {(n, deviation)}
            signs = np.sign([r["whitened"] for r in mine]) * np.sign(white) if signs is None else signs
            assert np.allclose([r["whitened"] for r in mine], white * signs, rtol=1e-8, atol=1e-9)
            assert np.allclose([r["explained"] for r in mine], explained, rtol=1e-10)
            assert len({r["identity_error"] for r in mine}) == 1 and mine[0]["identity_error"] < 1e-10


def test_odd_vectors(spark):
    rows = [(1, [0.5, 0.25, 0.25]), (2, [1.0, 0.25, 0.5]), (3, [0.0, 0.25, 0.0]), (4, [0.25, -0.5]), (5, [1e30, 2.0, 1.0, 3.0]), (6, [-1e30, 2.0, 1.0, 2.0])]
    got = {}
    for r in whitening.whiten(frame(spark, rows)).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert {i: len(r) for i, r in got.items()} == {1: 3, 2: 3, 3: 3, 4: 2, 5: 4, 6: 4}
    assert got[1][3]["whitened"] is None and got[1][1]["whitened"] is not None  # the second place never varies
    assert got[1][1]["identity_error"] < 1e-10
    assert got[4][1]["whitened"] is None and got[4][1]["explained"] is None and got[4][1]["identity_error"] is None
    assert got[4][1]["deviation"] == 0 and got[5][1]["deviation"] is None  # beyond a long
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
