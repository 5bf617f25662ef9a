"""Principal components by passes against those of the whole matrix."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidewatch.operators import components as P


def whole(x, k):
    """Components of a small matrix by Jacobi's rotations on its covariance."""
    about = x - x.mean(axis=0)
    values, vectors = P._eigen(P._inner(about, about) / (len(x) - 1))
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[:k], (vectors * signs).T[:k]


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(12)
    basis = P._orthonormal(rng.normal(size=(48, 6))).T
    return sum(rng.normal(size=(300, 1)) * s * b for s, b in zip((9, 6, 4, 2.5, 1.5, 1), basis, strict=True)) + rng.normal(size=(300, 48)) * 0.2 + rng.normal(size=48)


def test_rotations():
    a = np.random.default_rng(0).normal(size=(12, 12))
    values, vectors = P._eigen(a + a.T)
    assert np.allclose(P._times(a + a.T, vectors), vectors * values, atol=1e-9) and np.allclose(P._inner(vectors, vectors), np.eye(12), atol=1e-12)


def test_subspace(spark, wide):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(wide)], "i int, v array<double>").repartition(5)
    model = P.principal_components(df, "v", 4)
    values, vectors = whole(wide, 4)
    assert np.allclose(model.loadings, vectors, atol=1e-6) and np.allclose(model.variance, values, rtol=1e-8)
    assert math.isclose(model.total, wide.var(axis=0, ddof=1).sum(), rel_tol=1e-9) and model.n == 300 and model.passes < 30
    got = np.array([r["y"] for r in P.project(df, "v", model, "y").orderBy("i").collect()])
    assert np.allclose(got, [[((x - wide.mean(axis=0)) * w).sum() for w in vectors] for x in wide], atol=1e-5)
    stored = P.from_table(P.to_table(spark, model).collect())
    assert np.allclose(stored.loadings, model.loadings) and np.allclose(stored.mean, model.mean)


def test_rows_that_do_not_count(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * [5, 3, 1, 0, 0]).tolist()) for i in range(80)]
    bad = [(90, None), (91, [1.0, 2.0]), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [math.nan] * 5), (94, [math.inf] * 5)]
    make = lambda r: spark.createDataFrame(r, "i int, v array<double>")
    clean, dirty = (P.principal_components(make(r), "v", 5) for r in (rows, rows + bad))
    assert clean.loadings.shape == (3, 5) and np.allclose(clean.loadings, dirty.loadings) and dirty.n == 80
    got = {r["i"]: r["y"] for r in P.project(make(rows + bad), "v", dirty, "y").collect()}
    assert len(got) == 85 and all((got[i] is None) == (i >= 90) for i in got)
    assert P.principal_components(make(rows[:1]), "v", 2).loadings.size == 0
    same = P.principal_components(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]), "v", 2)
    assert same.loadings.shape == (0, 2) and same.total == 0
    assert P.principal_components(make([]), "v", 2).n == 0
