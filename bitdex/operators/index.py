"""Index build and query encoding.

``build_index`` encodes every body once (the vectors are written), fits the
projection on all of them -- mean and covariance are sums, so the fit needs one
pass and ``dim x dim`` numbers whatever the number of rows -- and projects and
sign-packs them in one Arrow pass. The result is the ``index`` table
``(row, ord, id, title, w0..)``: keys and slug columns in the same row, so they
can never misalign, and a dense ``row`` number that tells rows of one id apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as kx
from ..session import cut_lineage
from . import encode as enc
from . import ordinals as od
from . import pca as pc
from . import search as sr

DEFAULT_K = 256


ADDRESS = ["file", "position"]       # of a corpus row, where the corpus was read with it


def with_ord(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Stored ordinal for tie-breaks: the id itself when it is integral, unless there is
    one already or rows have an address (then corpus order decides). Without any of these rows
    are ordered by id and title, see ``number_rows``."""
    if "ord" in df.columns or set(ADDRESS) <= set(df.columns):
        return df
    if isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType)):
        return df.withColumn("ord", F.col(id_col).cast("long"))
    return df


def number_rows(index: DataFrame, k: int) -> DataFrame:
    """(row, ord, id, title, w0..) written: ``row`` is 0..n-1 by ``ord`` (or address, or neither), then
    id, title and key, so it is the same however the corpus is split; ``ord`` is the row where there is none."""
    words = kx.word_cols(k)
    lead = ADDRESS if set(ADDRESS) <= set(index.columns) else ["ord"] if "ord" in index.columns else []
    rows = od.dense_ordinal(index, [*lead, "id", "title", *words])
    if "ord" not in rows.columns:
        rows = rows.withColumn("ord", F.col("row"))
    return cut_lineage(rows.select("row", "ord", "id", "title", *words), "index")


def fit_params(vectors: DataFrame, k: int = DEFAULT_K, projection: str = "pca",
               vec: str = "vec") -> pc.PcaParams:
    """Fit on every row of ``vectors`` (R2, A1, A3). For a fit on a sample, pass
    ``pca.fit_sample(vectors, cap)`` (R1)."""
    pc.require_rows(vectors)
    if projection == "identity":
        return pc.PcaParams.identity(pc.dim_mean(vectors, vec), k)
    return pc.pca_fit(vectors, k, vec)


def build_index(bodies: DataFrame, encoder=None, k: int = DEFAULT_K,
                text: str = "body", projection: str = "pca",
                mode: str = "auto", min_partitions: int | None = None,
                params: pc.PcaParams | None = None):
    """(index, params): keys for **all** bodies.

    Without ``params`` the vectors are written once under the shared checkpoint
    folder and read by both the fit and the projection, so every body is encoded
    exactly once; with ``params`` encoding, projection and packing are one pass and
    no vector is written. The index is written too: it is scanned by searches and
    joined for titles. A lost executor only re-runs a part of one stage.
    """
    encoder = encoder or enc.HashPoolEncoder()
    bodies = with_ord(bodies)
    keep = [c for c in ("ord", *ADDRESS, "id", "title") if c in bodies.columns]
    rows = enc.spread(bodies.select(*keep, text), min_partitions)
    if params is None:
        vecs = cut_lineage(enc.embed(rows, text, "vec", encoder, mode).drop(text), "vectors")
        params = fit_params(vecs, k, projection)
        index = pc.project_keys(vecs, params, "vec", keep=keep)
    else:
        index = _keys(rows, text, encoder, params, mode, keep)
    return number_rows(index, params.k), params


def _keys(rows: DataFrame, text: str, encoder, params: pc.PcaParams, mode: str,
          keep: list[str]) -> DataFrame:
    """Keys for every row: one fused Arrow pass unless the encoder runs in
    the JVM."""
    if enc._use_jvm(encoder, mode):
        vecs = enc.embed(rows, text, "vec", encoder, mode).drop(text)
        return pc.project_keys(vecs, params, "vec", keep=keep)
    return pc.encode_project_keys(rows, text, encoder, params, keep)


def accepted_queries(queries: DataFrame, text: str = "text") -> DataFrame:
    """Queries with a text. Null and empty texts are rejected: they get no hits and
    no histogram. Blanks alone are a text."""
    return queries.filter(F.col(text).isNotNull() & (F.col(text) != ""))


def rejected_queries(queries: DataFrame, text: str = "text", qid: str = "qid") -> DataFrame:
    """(qid, reason) of the queries that get no answer."""
    return queries.filter(F.col(text).isNull() | (F.col(text) == "")).select(
        F.col(qid).alias("qid"), F.lit("empty query").alias("reason"))


def encode_queries(queries: DataFrame, params: pc.PcaParams, encoder=None,
                   text: str = "text", qid: str = "qid", mode: str = "auto"
                   ) -> DataFrame:
    """(qid, w0..) of each accepted query with the same encoder and params as the
    documents (C4); ``qid`` keeps its type. Texts without tokens encode to the zero
    vector (as documents do)."""
    encoder = encoder or enc.HashPoolEncoder()
    q = accepted_queries(queries, text).select(F.col(qid).alias("qid"), F.col(text).alias("_t"))
    return _keys(q, "_t", encoder, params, mode, ["qid"])


def search(queries: DataFrame, index: DataFrame, params: pc.PcaParams,
           encoder=None, top: int = sr.DEFAULT_TOP, text: str = "text",
           qid: str = "qid", mode: str = "auto") -> DataFrame:
    """Top ``top`` articles per query with distance, URL and flags."""
    qkeys = encode_queries(queries, params, encoder, text, qid, mode)
    return sr.resolve_hits(sr.knn(index, qkeys, params.k, top), index, params.k)


def search_one(query: str, index: DataFrame, params: pc.PcaParams, encoder=None,
               top: int = sr.DEFAULT_TOP) -> DataFrame:
    """Top ``top`` articles for a single query text: the key is encoded on the driver
    and the scan is one codegen'd stage (T1). An empty text raises."""
    if not query:
        raise ValueError("empty query")
    encoder = enc.loaded(encoder or enc.HashPoolEncoder())
    y = (encoder.encode_batch([query]) - params.mean) @ params.components.T
    words = pc.pack_signs_np(y, params.k)[0].tolist()
    hits = sr.topk_one(index, words, params.k, top).withColumn("qid", F.lit(query))
    return sr.resolve_hits(hits, index, params.k)


def stats(queries: DataFrame, index: DataFrame, params: pc.PcaParams,
          encoder=None, text: str = "text", qid: str = "qid",
          mode: str = "auto") -> DataFrame:
    """Distance histogram per query."""
    qkeys = encode_queries(queries, params, encoder, text, qid, mode)
    return sr.distance_histogram(index, qkeys, params.k).drop("q")


def key_table(index: DataFrame, k: int) -> DataFrame:
    """(id, key_hex) -- the stored 32-byte keys as hex (V7)."""
    return index.select("id", kx.key_hex(kx.word_cols(k)).alias("key_hex"))


def identity_params(vectors: DataFrame, k: int, vec: str = "vec") -> pc.PcaParams:
    return pc.PcaParams.identity(pc.dim_mean(vectors, vec), k)


__all__ = ["build_index", "encode_queries", "search", "search_one", "stats", "fit_params",
           "accepted_queries", "rejected_queries", "with_ord", "number_rows", "key_table", "identity_params"]
