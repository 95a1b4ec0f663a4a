"""PCA of vectors too wide for a covariance on the driver (A3): a block Krylov method.

The covariance ``C`` is never built. Each round multiplies it with a block of ``b`` directions in one
pass over the rows (``X' (X V)``, tall and skinny: a task holds ``dim x b`` sums, which are
added in two levels), and the driver looks for the leading eigenvectors inside the span of all blocks
so far (Rayleigh-Ritz). The next block is what the products add to that span. When the basis
would pass ``max_basis`` columns it restarts from its best half. The driver holds ``dim x max_basis`` numbers,
a few times the result, whatever the number of rows.

A fit ends when every wanted pair's residual ``|C v - lambda v|`` is below ``tol`` times the
largest eigenvalue, or when nothing is left to add. Signs are canonical, as in ``pca_fit``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pca as pc

EXTRA = 8                    # directions of a block beyond the components asked for
TOL = 1e-11
MAX_ROUNDS = 200
SEED = 1


def covariance_times(df: DataFrame, vec: str, mean: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """``C @ block`` in one pass over the rows."""
    shared = df.sparkSession.sparkContext.broadcast((mean, block))

    def partial(batches):
        m, v = shared.value
        out, seen = np.zeros(v.shape), False
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64) - m
                out += x.T @ (x @ v)
                seen = True
        if seen:
            yield pd.DataFrame({"i": np.arange(len(out), dtype=np.int32), "row": list(out)})

    parts = (df.select(F.col(vec).cast("array<double>").alias("v")).coalesce(pc.MAX_PARTIALS)
             .mapInPandas(partial, "i int, row array<double>"))
    merged = parts.withColumn("_g", F.spark_partition_id() % pc.MERGE).groupBy("i", "_g").agg(
        Summarizer.sum(array_to_vector("row")).alias("r"))
    rows = merged.groupBy("i").agg(Summarizer.sum(F.col("r")).alias("s")).select(
        "i", vector_to_array("s").alias("s")).toPandas()
    out = np.zeros(block.shape)
    out[rows["i"].to_numpy()] = np.stack(rows["s"].to_numpy())
    return out / max(1, n - 1)


def _added(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``block`` that ``basis`` doesn't span."""
    size = np.linalg.norm(block, axis=0).max(initial=0.0)
    for _ in range(2):                                   # once more: rounding of the first time
        block = block - basis @ (basis.T @ block)
    if not block.shape[1] or np.linalg.norm(block, axis=0).max() <= 1e-13 * size:
        return block[:, :0]
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-12 * s[0]]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0]


def pca_subspace(df: DataFrame, k: int, vec: str = "vec", tol: float = TOL, max_basis: int | None = None,
                 max_rounds: int = MAX_ROUNDS, seed: int = SEED) -> pc.PcaParams:
    """Top-``k`` eigenvectors of the covariance of all rows, as ``pca_fit`` gives them. ``df`` is scanned
    once a round: pass a written table."""
    pc.require_rows(df)
    stats = pc._vec(df, vec).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).first()["s"]
    mean, n = np.asarray(stats["mean"].toArray()), int(stats["count"])
    variance = float(np.asarray(stats["variance"].toArray()).sum())
    d = len(mean)
    if not 1 <= k <= d:
        raise ValueError(f"k must be between 1 and {d}; got {k}")
    width = min(d, k + EXTRA)
    most = min(d, max(max_basis or 4 * width, 2 * width))
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    basis, product = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(max_rounds):
        basis = np.concatenate([basis, block], axis=1)
        product = np.concatenate([product, covariance_times(df, vec, mean, block, n)], axis=1)
        t = basis.T @ product
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = basis @ turn, product @ turn
        residual = np.linalg.norm(images[:, :k] - vectors[:, :k] * values[:k], axis=0)
        if residual.max() <= tol * max(values[0], np.finfo(float).tiny) or basis.shape[1] == d:
            break
        block = _added((images - vectors * values)[:, :width], basis)      # residuals of the leading pairs
        if not block.shape[1]:
            break
        if basis.shape[1] + block.shape[1] > most:
            keep = max(width, most // 2)
            basis, product = vectors[:, :keep], images[:, :keep]
            block = _added(block, basis)
    else:
        raise ValueError(f"no convergence in {max_rounds} rounds: residual {residual.max():.3g}")
    return pc.PcaParams(mean, pc.canonical_signs(vectors[:, :k].T),
                        np.maximum(values[:k], 0) / variance if variance else np.zeros(k), n)
