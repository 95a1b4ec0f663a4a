"""Vector statistics, PCA and sign keys.

* ``dim_mean``: ``Summarizer.mean`` (one distributed pass, map-side partials).
* ``covariance``: centred Gram matrix / (n - 1). Each partition accumulates
  ``X_c^T X_c`` with numpy (``mapInPandas``) and emits one row per matrix row;
  the partials are added in two levels (``MERGE`` groups, then one), and at most
  ``MAX_PARTIALS`` tasks make them, so the shuffle is bounded by
  ``MAX_PARTIALS x dim`` rows however many files there are. Nothing of size n
  reaches the driver.
* ``pca_fit``: ``pyspark.ml.feature.PCA`` (distributed covariance, small
  local eigendecomposition), fitted on all rows. Eigenvector signs are made
  canonical (largest-magnitude entry positive) so stored keys are reproducible.
* ``fit_sample``: a sample of exact size, for callers that ask for one.
* ``project_keys``: centre with *our* mean (Spark's ``PCAModel.transform``
  does not centre), project, and pack the signs, in one Arrow pass with the
  ``dim x k`` parameters broadcast once per executor.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pcm
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as kx
from . import ordinals as od

# Fixed value: PCA needs two rows.
MIN_FIT_ROWS = 2
# Tasks that make partial Gram matrices, and the groups they are added in first.
MAX_PARTIALS = 4096
MERGE = 64
# Rows that are projected at a time.
SLICE = 1024


@dataclass
class PcaParams:
    """Mean and component rows (``k x dim``); small, held by the driver."""

    mean: np.ndarray
    components: np.ndarray
    explained_variance: np.ndarray = field(default_factory=lambda: np.zeros(0))
    n_fit: int = 0

    @property
    def dim(self) -> int:
        return int(self.mean.shape[0])

    @property
    def k(self) -> int:
        return int(self.components.shape[0])

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One-row ``params`` table."""
        schema = T.StructType([
            T.StructField("dim", T.IntegerType()),
            T.StructField("k", T.IntegerType()),
            T.StructField("n_fit", T.LongType()),
            T.StructField("mean", T.ArrayType(T.DoubleType())),
            T.StructField("components", T.ArrayType(T.ArrayType(T.DoubleType()))),
            T.StructField("explained_variance", T.ArrayType(T.DoubleType())),
        ])
        row = (self.dim, self.k, int(self.n_fit),
               [float(x) for x in self.mean],
               [[float(x) for x in r] for r in self.components],
               [float(x) for x in self.explained_variance])
        return spark.createDataFrame([row], schema)

    @staticmethod
    def from_df(df: DataFrame) -> "PcaParams":
        rows = df.limit(2).collect()
        if len(rows) != 1:
            raise ValueError("params table must hold exactly one row")
        r = rows[0]
        comps = np.asarray(r["components"], dtype=np.float64)
        p = PcaParams(np.asarray(r["mean"], dtype=np.float64),
                      comps.reshape(len(r["components"]), -1),
                      np.asarray(r["explained_variance"] or [], dtype=np.float64),
                      int(r["n_fit"] or 0))
        if p.components.shape[1] != p.dim or p.dim != r["dim"] or p.k != r["k"]:
            raise ValueError("params dims disagree")
        return p

    @staticmethod
    def identity(mean: np.ndarray, k: int) -> "PcaParams":
        """Centre, then keep the first ``k`` coordinates (no rotation)."""
        d = len(mean)
        return PcaParams(np.asarray(mean, dtype=np.float64),
                         np.eye(d, dtype=np.float64)[:k])


def _vec(df: DataFrame, col: str) -> DataFrame:
    return df.select(array_to_vector(F.col(col).cast("array<double>")).alias("_v"))


# -- A1 ----------------------------------------------------------------------

def dim_mean(df: DataFrame, vec: str = "vec") -> np.ndarray:
    """Mean of each dimension (one aggregation pass; d numbers to the driver)."""
    row = _vec(df, vec).agg(Summarizer.mean(F.col("_v")).alias("m")).first()
    return np.asarray(row["m"].toArray(), dtype=np.float64)


def dim_mean_table(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(dim, mean) rows, for inspection and the oracle."""
    m = _vec(df, vec).agg(Summarizer.mean(F.col("_v")).alias("m"))
    return m.select(F.posexplode(vector_to_array("m")).alias("dim", "mean"))


# -- A2 ----------------------------------------------------------------------

def covariance(df: DataFrame, vec: str = "vec", mean: np.ndarray | None = None
               ) -> DataFrame:
    """(i, j, cov): centred Gram matrix divided by n - 1 (by 1 when n <= 1)."""
    spark = df.sparkSession
    mean = dim_mean(df, vec) if mean is None else np.asarray(mean, dtype=np.float64)
    d = len(mean)
    bmean = spark.sparkContext.broadcast(mean)

    def partial(batches):
        m = bmean.value
        g = np.zeros((len(m), len(m)))
        n = 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64) - m
            g += x.T @ x
            n += len(x)
        if n:
            yield pd.DataFrame({"i": np.arange(len(m), dtype=np.int32),
                                "n": np.full(len(m), n, dtype=np.int64),
                                "row": list(g)})

    parts = (df.select(F.col(vec).cast("array<double>").alias("v")).coalesce(MAX_PARTIALS)
             .mapInPandas(partial, "i int, n long, row array<double>"))
    merged = (parts.withColumn("_g", F.spark_partition_id() % MERGE).groupBy("i", "_g")
              .agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("row")).alias("r")))
    summed = merged.groupBy("i").agg(F.sum("n").alias("n"), Summarizer.sum(F.col("r")).alias("s"))
    denom = F.when(F.col("n") > 1, F.col("n") - 1).otherwise(F.lit(1))
    return summed.select(
        "i", F.posexplode(vector_to_array("s")).alias("j", "g"), denom.alias("_d")
    ).select("i", "j", (F.col("g") / F.col("_d")).alias("cov"))


# -- R1 / R2 -----------------------------------------------------------------

def require_rows(df: DataFrame, n: int = MIN_FIT_ROWS) -> None:
    """PCA needs at least two rows (R2); cheap eager guard."""
    got = df.limit(n).count()
    if got < n:
        raise ValueError(f"need >= {n} rows to fit PCA; got {got}")


def fit_sample(df: DataFrame, cap: int, order: list[str] | None = None, seed: int = od.DRAW_SEED
               ) -> DataFrame:
    """All rows when there are at most ``cap``; else exactly ``cap`` rows drawn uniformly with
    replacement (R1), the same for every partitioning. Draws are ordinals: those of the column
    ``row`` if there is one, else places in the order of the columns ``order`` (all, by default)."""
    if df.count() <= cap:
        return df
    if order is None and "row" in df.columns:
        return od.sample_exact(df, cap, seed)
    numbered = od.dense_ordinal(df.withColumnRenamed("row", "_row"), [
        "_row" if c == "row" else c for c in order or df.columns])
    return od.sample_exact(numbered, cap, seed).drop("row").withColumnRenamed("_row", "row")


# -- A3 / A4 -----------------------------------------------------------------

def canonical_signs(components: np.ndarray) -> np.ndarray:
    """Flip each row so its largest-magnitude entry is positive."""
    c = np.array(components, dtype=np.float64)
    idx = np.argmax(np.abs(c), axis=1)
    flip = c[np.arange(len(c)), idx] < 0
    c[flip] *= -1
    return c


def pca_fit(df: DataFrame, k: int, vec: str = "vec") -> PcaParams:
    """Top-``k`` eigenvectors of the covariance of all rows, largest eigenvalue
    first. ``df`` is scanned more than once: pass a written table."""
    require_rows(df)
    vecs = _vec(df, vec)
    stats = vecs.agg(Summarizer.metrics("mean", "count").summary(F.col("_v"))
                     .alias("s")).first()["s"]
    model = PCA(k=k, inputCol="_v", outputCol="_y").fit(vecs)
    return PcaParams(np.asarray(stats["mean"].toArray(), dtype=np.float64),
                     canonical_signs(model.pc.toArray().T),
                     np.asarray(model.explainedVariance.toArray(), dtype=np.float64),
                     int(stats["count"]))


def pca_checks(df: DataFrame, params: PcaParams, vec: str = "vec") -> DataFrame:
    """(component, residual, norm, cross) of a fit, from the covariance of all rows ``C``:
    ``|C v - lambda v|`` with ``lambda = v C v``, ``v . v`` and the largest ``|v . u|``
    with another component. A right fit gives 0, 1 and 0. ``dim x dim`` numbers reach
    the driver."""
    cov = np.zeros((params.dim, params.dim))
    for r in covariance(df, vec, params.mean).groupBy("i").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("j", "cov"))), lambda x: x["cov"])
            .alias("row")).collect():
        cov[r["i"]] = r["row"]
    v = params.components
    cv = v @ cov
    lam = (cv * v).sum(axis=1)
    cross = np.abs(v @ v.T - np.diag((v * v).sum(axis=1))).max(axis=1) if len(v) > 1 else [0.0]
    rows = [(i, float(np.linalg.norm(cv[i] - lam[i] * v[i])), float(v[i] @ v[i]), float(c))
            for i, c in enumerate(cross)]
    return df.sparkSession.createDataFrame(
        rows, "component int, residual double, norm double, cross double")


def explained_variance_table(spark: SparkSession, params: PcaParams) -> DataFrame:
    """(component, explained_variance, cumulative) (A4)."""
    ev = params.explained_variance
    rows = [(i, float(v), float(np.sum(ev[: i + 1]))) for i, v in enumerate(ev)]
    return spark.createDataFrame(rows, "component int, explained_variance double, "
                                       "cumulative double")


# -- V4 / V5 / V6 ------------------------------------------------------------

def pack_signs_np(y: np.ndarray, k: int) -> np.ndarray:
    """(n, k) floats -> (n, words) int64, bit = y > 0 (NaN and 0 give 0),
    most significant bit first."""
    nw = kx.n_words(k)
    bits = np.zeros((y.shape[0], nw * 64), dtype=np.uint8)
    with np.errstate(invalid="ignore"):
        bits[:, :k] = y > 0
    packed = np.packbits(bits, axis=1)            # big-endian bytes
    return packed.view(">u8").astype(np.uint64).view(np.int64)


def project_keys(df: DataFrame, params: PcaParams, vec: str = "vec",
                 keep: list[str] | None = None, with_y: bool = False) -> DataFrame:
    """Keys ``w0..`` for every row: sign of ``components . (v - mean)``.

    Rows whose vector has the wrong length get null keys (checked, never
    padded)."""
    spark = df.sparkSession
    keep = list(keep or [c for c in df.columns if c != vec])
    k, d = params.k, params.dim
    words = kx.word_cols(k)
    bp = spark.sparkContext.broadcast((params.mean, params.components))
    in_schema = df.select(*keep).schema
    fields = list(in_schema.fields) + [T.StructField(w, T.LongType()) for w in words]
    if with_y:
        fields.append(T.StructField("y", T.ArrayType(T.DoubleType())))
    out_schema = T.StructType(fields)

    names = [f.name for f in fields]

    def run(batches):
        mean, comps = bp.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                vals = part.column(len(keep))
                ok = pcm.fill_null(pcm.list_value_length(vals), -1).to_numpy() == d
                x = vals.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = np.full((len(ok), k), np.nan)
                y[ok] = (x - mean) @ comps.T
                packed = pack_signs_np(np.nan_to_num(y, nan=0.0), k)
                out = [*part.columns[:len(keep)], *[pa.array(packed[:, j], mask=~ok) for j in range(len(words))]]
                if with_y:
                    out.append(pa.array([r if o else None for r, o in zip(y, ok)], pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(out, names=names)

    src = df.select(*keep, F.col(vec).cast("array<double>").alias("_v"))
    return src.mapInArrow(run, out_schema)


def encode_project_keys(df: DataFrame, text: str, encoder, params: PcaParams,
                        keep: list[str]) -> DataFrame:
    """Encode, centre, project and sign-pack in **one** Arrow pass: the wide
    vectors never leave the Python worker (C2 + V4 + V5 + V6). The ``dim x k``
    parameters are broadcast once per executor; the encoder travels with the
    function (a model is loaded in the worker, see ``EncoderSource``)."""
    from .encode import loaded
    spark = df.sparkSession
    k = params.k
    words = kx.word_cols(k)
    bp = spark.sparkContext.broadcast((params.mean, params.components))
    fields = list(df.select(*keep).schema.fields) + [T.StructField(w, T.LongType())
                                                     for w in words]

    names = [f.name for f in fields]

    def run(batches):
        mean, comps = bp.value
        enc = loaded(encoder)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = enc.encode_batch(part.column(len(keep)).to_pylist())
                if x.shape[1] != len(mean):
                    raise ValueError("encoder width differs from the params")
                packed = pack_signs_np((x - mean) @ comps.T, k)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], *[pa.array(packed[:, j]) for j in range(len(words))]], names=names)

    return df.select(*keep, F.col(text).alias("_t")).mapInArrow(run, T.StructType(fields))
