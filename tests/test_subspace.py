"""Block Krylov PCA (A3) against the present fit."""

import numpy as np
import pytest

from bitdex.operators import pca as pc
from bitdex.operators import subspace as ss


def _rows(spark, x, parts=3):
    return spark.createDataFrame([(r.tolist(),) for r in x], "vec array<double>").repartition(parts).cache()


def test_equals_the_fit_on_embeddings(spark, sf001):
    e = spark.read.parquet(f"{sf001}/embeddings.parquet")
    a, b = pc.pca_fit(e, 6, "embedding"), ss.pca_subspace(e, 6, "embedding")
    assert np.allclose(a.components, b.components, atol=1e-8) and np.allclose(a.mean, b.mean)
    assert np.allclose(a.explained_variance, b.explained_variance, atol=1e-10) and a.n_fit == b.n_fit
    for r in pc.pca_checks(e, b, "embedding").collect():
        assert r.residual < 1e-8 and abs(r.norm - 1) < 1e-10 and r.cross < 1e-10


@pytest.mark.parametrize("max_basis", [None, 24])
def test_wide_vectors_with_restarts(spark, max_basis):
    """300 dimensions, basis far below: rounds restart and still converge."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 300)) * (0.9 ** np.arange(300)) @ np.linalg.qr(rng.normal(size=(300, 300)))[0] + 3.0
    got = ss.pca_subspace(_rows(spark, x), 4, max_basis=max_basis)
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    want = pc.canonical_signs(vectors[:, ::-1][:, :4].T)
    assert np.allclose(got.components, want, atol=1e-8)
    assert np.allclose(got.explained_variance, values[::-1][:4] / values.sum(), atol=1e-10)


def test_low_rank_equal_rows_and_guards(spark):
    rng = np.random.default_rng(6)
    x = np.outer(rng.normal(size=30), rng.normal(size=12))          # one direction
    got = ss.pca_subspace(_rows(spark, x), 3)
    assert got.explained_variance[0] == pytest.approx(1.0) and np.allclose(got.explained_variance[1:], 0, atol=1e-12)
    assert np.allclose(got.components @ got.components.T, np.eye(3), atol=1e-9)
    same = ss.pca_subspace(_rows(spark, np.ones((5, 4))), 2)
    assert np.allclose(same.explained_variance, 0)
    with pytest.raises(ValueError, match="need >= 2 rows"):
        ss.pca_subspace(_rows(spark, np.ones((1, 4))), 2)
    with pytest.raises(ValueError, match="k must be"):
        ss.pca_subspace(_rows(spark, np.ones((3, 4))), 5)
