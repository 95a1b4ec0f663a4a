"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (``documents``, ``embeddings``,
``benchmark``, ``conversations``) in full. Text queries use the corpus view
over ``documents`` (title = first line), the built-in hash-pool encoder
(384-d, no token limit) and 256-bit keys. ``*_sql`` partners live in ``oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as kx
from ..functions import text as tx
from ..operators import encode as enc
from ..operators import index as ix
from ..operators import multi_index as mi
from ..operators import ordinals as od
from ..operators import pca as pc
from ..operators import search as sr
from ..operators import subspace as ss
from ..operators import tokens as tk
from ..operators import units as un
from ..operators import wordpiece as wp
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import corpus as cs
from ..sources import store as st
from . import oracle as oq

DIM = 384
K = 256
EK = 64
PK = 4              # components of the PCA queries that SQL computes too
TOP = 5
CONTEXT = 510       # tokens of a model context without its two framing tokens
N_CTX = 512         # positions of a model context
# CPU-heavy steps spread small inputs over the session's default
# parallelism (None); large inputs keep their scan partitioning.
MIN_PARTITIONS = None


def _encoder() -> enc.HashPoolEncoder:
    return enc.HashPoolEncoder(DIM)


def _corpus(spark: SparkSession, sf: str, address: bool = False) -> DataFrame:
    return cs.documents_corpus(spark, sf, address)


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    return un.build_bodies(_corpus(spark, sf), encoder=_encoder(),
                           min_partitions=MIN_PARTITIONS)


# -- text -----------------------------------------------------------------------

def corpus_titles(spark, sf):
    c = _corpus(spark, sf)
    return c.filter(tx.non_empty("text")).select(
        "id", "title", tx.clean_title("title").alias("clean_title"),
        tx.title_query("title").alias("title_query"),
        F.length("text").alias("n_chars"))


def normalized_text(spark, sf):
    c = _corpus(spark, sf).filter(tx.non_empty("text"))
    return c.select("id", tx.normalize_ws("text").alias("normalized"))


def lead_bodies(spark, sf):
    c = _corpus(spark, sf).filter(tx.non_empty("text"))
    return c.select("id", tx.lead("text").alias("body"))


def text_units(spark, sf):
    r = un.route_columns(_corpus(spark, sf).filter(tx.is_long("text")))
    return r.select("id", F.posexplode("units").alias("pos", "unit"))


def routes(spark, sf):
    r = un.route_columns(_corpus(spark, sf))
    return r.select("id", tx.is_long("text").alias("is_long"),
                    F.when(F.col("units").isNotNull(), F.size("units")).alias("n_units"),
                    F.col("extractive"))


def worklist(spark, sf):
    return un.extraction_worklist(_corpus(spark, sf))


def folded_text(spark, sf):
    c = _corpus(spark, sf).filter(tx.non_empty("text"))
    return c.select("id", tx.fold_text("text").alias("folded"))


def basic_tokens(spark, sf):
    c = enc.spread(_corpus(spark, sf).filter(tx.non_empty("text")))
    return tk.token_table(c, "id", "text")


def token_profile(spark, sf):
    c = enc.spread(_corpus(spark, sf).filter(tx.non_empty("text")))
    return tk.token_profile(c, "id", "text", CONTEXT)


def corpus_profile(spark, sf):
    return tk.corpus_profile(_corpus(spark, sf))


def _bench_vocab(spark, sf):
    return wp.vocab_from_text(cs.table(spark, sf, "benchmark"), "text")


def _doc_tokens(spark, sf):
    c = enc.spread(_corpus(spark, sf).filter(tx.non_empty("text")))
    return tk.token_table(c, "id", "text")


def wordpiece_words(spark, sf):
    """Every distinct document word segmented against the benchmark vocab."""
    words = _doc_tokens(spark, sf).select(F.col("token").alias("word"))
    seg = wp.segment_words(words, _bench_vocab(spark, sf))
    return seg.select("word", "known", F.size("piece_ids").alias("n_pieces"),
                      F.array_join(F.transform("piece_ids", lambda x: x.cast("string")), " ")
                      .alias("pieces"))


def token_pieces(spark, sf):
    """Every document token with its word's pieces."""
    t = wp.token_ids(_doc_tokens(spark, sf), _bench_vocab(spark, sf))
    return t.select("id", "pos", "token", "known", F.size("piece_ids").alias("n_pieces"))


def wordpiece_profile(spark, sf):
    """Over every document and every turn of conversations (id -1 - qid), whether or not it has words."""
    docs = _corpus(spark, sf).select("id", "text").unionByName(
        _conv_queries(spark, sf).select((-1 - F.col("qid")).alias("id"), "text"))
    tokens = tk.token_table(enc.spread(docs.filter(tx.non_empty("text"))), "id", "text")
    return wp.piece_profile(tokens, docs, _bench_vocab(spark, sf))


def token_ids_limited(spark, sf):
    """The ids that a model of 512 positions reads of every document, framed and cut."""
    docs = enc.spread(_corpus(spark, sf).filter(tx.non_empty("text")))
    got = wp.limited_ids(docs, _bench_vocab(spark, sf), N_CTX)
    return got.select("id", F.size("ids").alias("n_ids"), "whole",
                      F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


# -- bodies -----------------------------------------------------------------------

def bodies(spark, sf):
    return _bodies(spark, sf)


def records(spark, sf):
    """Bodies written as record lines and parsed back (S3 + S2)."""
    return cs.parse_records(cs.record_lines(_bodies(spark, sf)))


def doc_token_sums(spark, sf):
    b = enc.spread(_bodies(spark, sf), MIN_PARTITIONS)
    e = _encoder()
    s = b.select("id", enc.token_sums_col("body", e).alias("s"))
    return s.select("id", F.posexplode("s").alias("dim", "s")) \
        .select("id", "dim", F.col("s").cast("long").alias("s"))


def even_token_sums(spark, sf):
    """``doc_token_sums`` by batches of like length."""
    b = enc.spread(_bodies(spark, sf), MIN_PARTITIONS).select("id", "body")
    s = enc.embed_even(b, "body", "s", enc.SumsEncoder(_encoder()), n_ctx=N_CTX)
    return s.select("id", F.posexplode("s").alias("dim", "s")).select("id", "dim", F.col("s").cast("long").alias("s"))


def _ranked(spark, sf):
    vecs = un.worklist_vectors(_corpus(spark, sf), _encoder())
    return un.rank_units(un.score_units(vecs))


def unit_scores(spark, sf):
    """Table forms: worklist -> vectors -> J1 scores -> W1 rank -> W2 budget."""
    w = F.sum(F.length("unit") + 1).over(
        Window.partitionBy("id").orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _ranked(spark, sf).select("id", "pos", F.round("score", 6).alias("score"), "rank",
                                     w.alias("running")) \
        .withColumn("chosen", (F.col("rank") == 1) | (F.col("running") <= tx.DEFAULT_CAP))


def extracted_bodies(spark, sf):
    """W1 + W2 + T2 table forms over the scored units of long articles."""
    vecs = un.worklist_vectors(_corpus(spark, sf), _encoder())
    chosen = un.chosen_units(un.score_units(vecs), tx.DEFAULT_CAP)
    return un.restore_order(chosen, tx.DEFAULT_CAP)


def doc_means(spark, sf):
    """Mean-pooled token signs of each body, a table of token vectors (A5): the pooled
    vector's first eight coordinates."""
    b = _bodies(spark, sf).select("id", F.explode(tx.tokenize("body")).alias("token"))
    hashed = b.select("id", F.md5("token").alias("h"))          # one hash a token; its digits are 0-9a-f
    bits = F.array(*[F.when(F.substring("h", i + 1, 1) > "7", 1.0).otherwise(-1.0) for i in range(8)])
    v = enc.mean_pool(hashed.select("id", bits.alias("v")), "id", "v")
    return v.select("id", F.posexplode("vec").alias("dim", "x")).select(
        "id", "dim", F.round("x", 6).alias("x"))


# -- index (identity projection: oracle-checkable) -----------------------------------

def _identity_index(spark, sf):
    b = _bodies(spark, sf)
    return ix.build_index(b, _encoder(), K, projection="identity",
                          min_partitions=MIN_PARTITIONS)


def doc_keys(spark, sf):
    index, _ = _identity_index(spark, sf)
    return ix.key_table(index, K)


def index_count(spark, sf):
    """Keys of the index: one for each body, so the bodies are counted."""
    return _bodies(spark, sf).agg(F.count(F.lit(1)).alias("n_keys"))


def fit_sample(spark, sf):
    """R1 with a cap over the number of bodies: all of them."""
    rows = cut_lineage(_bodies(spark, sf).select("id"), "rows")
    return pc.fit_sample(rows, rows.count())


def _dense_rows(spark, sf):
    docs = _corpus(spark, sf, address=True).select("file", "position", "id")
    return od.dense_ordinal(docs, ["file", "position"]).select("row", "id")


def dense_rows(spark, sf):
    """Every document under its number 0..n-1 in corpus order (file, position)."""
    return _dense_rows(spark, sf)


def sampled_rows(spark, sf):
    """Half as many draws as there are documents, with replacement."""
    rows = cut_lineage(_dense_rows(spark, sf), "rows")
    return pc.fit_sample(rows, rows.count() // 2)


def fit_guard(spark, sf):
    """What a fit says of one row and of all (R2)."""
    e = _emb(spark, sf).select("vec_id", "embedding")
    said = []
    for name, rows in (("one row", e.orderBy("vec_id").limit(1)), ("all rows", e)):
        try:
            said.append((name, f"fitted on {pc.pca_fit(rows, PK, 'embedding').n_fit}"))
        except ValueError as error:
            said.append((name, str(error)))
    return spark.createDataFrame(said, "input string, outcome string")


def _bench_queries(spark, sf):
    return cs.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _conv_queries(spark, sf):
    c = cs.table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("qid"), "text")


def query_texts(spark, sf):
    """Query strings as the search reads them: the words of each turn
    gathered with single spaces (F1)."""
    q = _conv_queries(spark, sf)
    words = F.filter(F.split(tx.normalize_ws("text"), " ", -1), lambda w: w != "")
    return q.select("qid", tx.gather_query(words).alias("query"),
                    F.size(words).alias("n_words"))


def benchmark_search(spark, sf):
    index, params = _identity_index(spark, sf)
    return ix.search(_bench_queries(spark, sf), index, params, _encoder(), TOP)


def conversation_search(spark, sf):
    index, params = _identity_index(spark, sf)
    return ix.search(_conv_queries(spark, sf), index, params, _encoder(), TOP)


def benchmark_stats(spark, sf):
    index, params = _identity_index(spark, sf)
    return ix.stats(_bench_queries(spark, sf), index, params, _encoder())


def histogram_order(spark, sf):
    """The rows of ``benchmark_stats`` under their place in it."""
    return od.numbered(benchmark_stats(spark, sf), "place").select("place", "qid", "bin", "count")


def knn_indexed(spark, sf):
    """``benchmark_search`` through the stored block index: written, packed, loaded; queries that its
    levels don't settle go to the scan (J3, C5)."""
    root = _run_folder(spark)
    st.rebuild(spark, *_identity_index(spark, sf), root)
    st.pack_blocks(spark, root)
    index, params = st.load_index(spark, root)
    qkeys = ix.encode_queries(_bench_queries(spark, sf), params, _encoder())
    hits, _ = mi.knn_indexed(index, st.load_blocks(spark, root), qkeys, TOP)
    return sr.resolve_hits(hits, index, K)


def nearest_bodies(spark, sf):
    """Every body's own key looked up in the block index: the key at distance 0 of lowest ordinal,
    which the first level settles without a scan (J3)."""
    root = _run_folder(spark)
    index, _ = _identity_index(spark, sf)
    blocks = mi.write_buckets(index, K, root)
    asked = index.select(F.col("id").alias("qid"), *kx.word_cols(K))
    hits, _ = mi.knn_indexed(index, blocks, asked, 1, share=1.0)
    found = index.select("row", F.col("id").alias("nearest"))
    return hits.join(found, "row").select(F.col("qid").alias("id"), "nearest", "dist")


def _run_folder(spark) -> str:
    """A new folder of the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"


def stored_search(spark, sf):
    """Write -> pack -> load -> rebuild -> load -> search: the whole index is stored as loose tables,
    packed as a bundle, rebuilt from what is loaded of it, and the newest bundle answers (S4, S5, S6, C7)."""
    root = _run_folder(spark)
    index, params = _identity_index(spark, sf)
    st.write_index(index, params, root)
    st.pack_index(spark, root)
    st.rebuild(spark, *st.load_index(spark, root), root)
    index, params = st.load_index(spark, root)
    return ix.search(_bench_queries(spark, sf), index, params, _encoder(), TOP)


def record_files(spark, sf):
    """Bodies written to record files and read back."""
    root = _run_folder(spark)
    cs.write_records(_bodies(spark, sf), root)
    return cs.read_records(spark, root)


def corpus_scan(spark, sf):
    """A parquet corpus scanned as (id, title, text)."""
    return cs.read_corpus(spark, f"{sf}/documents.parquet", id="doc_id", title="source")


def search_one(spark, sf):
    """Top hits of single queries (T1): the first words of the first document and of the
    last, each answered by the codegen'd path."""
    index, params = _identity_index(spark, sf)
    c = _corpus(spark, sf)
    ends = c.agg(F.min_by("text", "id").alias("a"), F.max_by("text", "id").alias("b")).first()
    hits = [ix.search_one(t, index, params, _encoder(), TOP).withColumn("qid", F.lit(i))
            for i, t in enumerate((ends["a"], ends["b"]))]
    return hits[0].unionByName(hits[1])


def _edge_queries(spark, sf):
    """Benchmark texts under ids that are strings, one id shared by all even items, and an
    empty and a null text for each."""
    q = cs.table(spark, sf, "benchmark")
    return q.select(F.when(F.col("item_id") % 2 == 0, F.lit("even")).otherwise(
        F.concat(F.lit("q"), F.col("item_id"))).alias("qid"),
        F.explode(F.array("text", F.lit(""), F.lit(None))).alias("text"))


def _edge_index(spark, sf):
    """Bodies under hash ids of any sign, each row twice."""
    h = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 15), 16, 10).cast("bigint")
    signed = F.when(F.col("id") % 2 == 0, -h).otherwise(h)
    twice = _bodies(spark, sf).select(signed.alias("id"), "title", "body", F.explode(F.array(F.lit(0), F.lit(1))))
    return ix.build_index(twice, _encoder(), K, projection="identity", min_partitions=MIN_PARTITIONS)


def search_edge(spark, sf):
    """Shared query ids, empty and null queries; hash ids, each in the index twice."""
    index, params = _edge_index(spark, sf)
    return ix.search(_edge_queries(spark, sf), index, params, _encoder(), TOP)


def stats_edge(spark, sf):
    index, params = _edge_index(spark, sf)
    return ix.stats(_edge_queries(spark, sf), index, params, _encoder())


# -- PCA --------------------------------------------------------------------------

def pca_checks(spark, sf):
    """The PCA of all document vectors (384 -> 256) held against their covariance: each
    component's residual, norm and largest product with another (A3, C3)."""
    vecs = cut_lineage(enc.embed(enc.spread(_bodies(spark, sf)), "body", "vec", _encoder()).select("vec"), "vectors")
    got = pc.pca_checks(vecs, pc.pca_fit(vecs, K))
    return got.select("component", (F.col("residual") < 1e-8).alias("is_eigenvector"),
                      (F.abs(F.col("norm") - 1) < 1e-9).alias("is_unit"),
                      (F.col("cross") < 1e-9).alias("is_orthogonal"))


def _pca_index(spark, sf):
    """Embeddings, ``PK`` leading components."""
    e = _emb(spark, sf)
    params = pc.pca_fit(e, PK, "embedding")
    index = pc.project_keys(e.select(F.col("vec_id").alias("ord"), "embedding"),
                            params, "embedding", keep=["ord"])
    return index, params


def pca_keys(spark, sf):
    index, _ = _pca_index(spark, sf)
    return index.select(F.col("ord").alias("vec_id"), "w0")


def pca_variance(spark, sf):
    _, params = _pca_index(spark, sf)
    v = pc.explained_variance_table(spark, params)
    return v.select("component", F.round("explained_variance", 6).alias("explained_variance"),
                    F.round("cumulative", 6).alias("cumulative"))


def pca_subspace(spark, sf):
    """``pca_variance`` by the block method for wide vectors (A3, A4)."""
    params = ss.pca_subspace(_emb(spark, sf), PK, "embedding")
    v = pc.explained_variance_table(spark, params)
    return v.select("component", F.round("explained_variance", 6).alias("explained_variance"),
                    F.round("cumulative", 6).alias("cumulative"))


def pca_search(spark, sf):
    index, params = _pca_index(spark, sf)
    hits = sr.knn(index, _label_queries(spark, sf, params), PK, TOP)
    return hits.select("qid", "rank", F.col("ord").alias("vec_id"), "dist")


def pca_stats(spark, sf):
    index, params = _pca_index(spark, sf)
    return sr.distance_histogram(index, _label_queries(spark, sf, params), PK).drop("q")


# -- embeddings fixture (64-d vectors, identity projection, 64-bit keys) ------------

def _emb(spark, sf):
    return cs.table(spark, sf, "embeddings")


def _emb_index(spark, sf):
    e = _emb(spark, sf)
    params = ix.identity_params(e, EK, "embedding")
    index = pc.project_keys(e.select(F.col("vec_id").alias("ord"), "embedding"),
                            params, "embedding", keep=["ord"])
    return index, params


def _label_queries(spark, sf, params):
    e = _emb(spark, sf)
    cen = (e.groupBy("label")
           .agg(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
                .alias("m"))
           .select(F.col("label").cast("long").alias("qid"), vector_to_array("m").alias("v")))
    return pc.project_keys(cen, params, "v", keep=["qid"])


def dim_mean(spark, sf):
    m = pc.dim_mean_table(_emb(spark, sf), "embedding")
    return m.select("dim", F.round("mean", 10).alias("mean"))


def covariance(spark, sf):
    cov = pc.covariance(_emb(spark, sf), "embedding")
    return cov.select("i", "j", F.round("cov", 10).alias("cov"))


def centered_keys(spark, sf):
    index, _ = _emb_index(spark, sf)
    return index.select(F.col("ord").alias("vec_id"), "w0",
                        kx.key_hex(kx.word_cols(EK)).alias("key_hex"))


def label_knn(spark, sf):
    index, params = _emb_index(spark, sf)
    hits = sr.knn(index, _label_queries(spark, sf, params), EK, TOP)
    return hits.select(
        "qid", "rank", F.col("ord").alias("vec_id"), "dist",
        kx.low_flag("dist", EK).alias("low"), kx.confidence_band("dist", EK).alias("band"),
        F.round(kx.est_cosine("dist", EK), 6).alias("est_cosine"))


def label_histogram(spark, sf):
    index, params = _emb_index(spark, sf)
    return sr.distance_histogram(index, _label_queries(spark, sf, params), EK).drop("q")


def label_nearest(spark, sf):
    """Nearest distance and index size for each label centroid."""
    index, params = _emb_index(spark, sf)
    return sr.nearest_distance(index, _label_queries(spark, sf, params), EK).drop("q")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "corpus_titles": corpus_titles,
    "normalized_text": normalized_text,
    "lead_bodies": lead_bodies,
    "text_units": text_units,
    "routes": routes,
    "worklist": worklist,
    "folded_text": folded_text,
    "basic_tokens": basic_tokens,
    "token_profile": token_profile,
    "corpus_profile": corpus_profile,
    "wordpiece_words": wordpiece_words,
    "token_pieces": token_pieces,
    "wordpiece_profile": wordpiece_profile,
    "token_ids_limited": token_ids_limited,
    "bodies": bodies,
    "records": records,
    "doc_token_sums": doc_token_sums,
    "even_token_sums": even_token_sums,
    "unit_scores": unit_scores,
    "extracted_bodies": extracted_bodies,
    "doc_means": doc_means,
    "corpus_scan": corpus_scan,
    "record_files": record_files,
    "doc_keys": doc_keys,
    "index_count": index_count,
    "fit_sample": fit_sample,
    "dense_rows": dense_rows,
    "sampled_rows": sampled_rows,
    "fit_guard": fit_guard,
    "query_texts": query_texts,
    "benchmark_search": benchmark_search,
    "conversation_search": conversation_search,
    "benchmark_stats": benchmark_stats,
    "histogram_order": histogram_order,
    "stored_search": stored_search,
    "knn_indexed": knn_indexed,
    "nearest_bodies": nearest_bodies,
    "search_one": search_one,
    "search_edge": search_edge,
    "stats_edge": stats_edge,
    "pca_checks": pca_checks,
    "pca_keys": pca_keys,
    "pca_variance": pca_variance,
    "pca_subspace": pca_subspace,
    "pca_search": pca_search,
    "pca_stats": pca_stats,
    "dim_mean": dim_mean,
    "covariance": covariance,
    "centered_keys": centered_keys,
    "label_knn": label_knn,
    "label_histogram": label_histogram,
    "label_nearest": label_nearest,
}

ORACLE: dict[str, str] = {
    "corpus_titles": oq.corpus_titles_sql(),
    "normalized_text": oq.normalized_text_sql(),
    "lead_bodies": oq.lead_bodies_sql(),
    "text_units": oq.text_units_sql(),
    "routes": oq.routes_sql(),
    "worklist": oq.worklist_sql(),
    "folded_text": oq.folded_text_sql(),
    "basic_tokens": oq.basic_tokens_sql(),
    "token_profile": oq.token_profile_sql(),
    "corpus_profile": oq.corpus_profile_sql(),
    "wordpiece_words": oq.wordpiece_words_sql(),
    "token_pieces": oq.token_pieces_sql(),
    "wordpiece_profile": oq.wordpiece_profile_sql(),
    "token_ids_limited": oq.token_ids_limited_sql(),
    "bodies": oq.bodies_sql(),
    "records": oq.records_sql(),
    "doc_token_sums": oq.doc_token_sums_sql(),
    "even_token_sums": oq.doc_token_sums_sql(),
    "unit_scores": oq.unit_scores_sql(),
    "extracted_bodies": oq.extracted_bodies_sql(),
    "doc_keys": oq.doc_keys_sql(),
    "index_count": oq.index_count_sql(),
    "fit_sample": oq.fit_sample_sql(),
    "dense_rows": oq.dense_rows_sql(),
    "sampled_rows": oq.sampled_rows_sql(),
    "fit_guard": oq.fit_guard_sql(),
    "query_texts": oq.query_texts_sql(),
    "benchmark_search": oq.search_sql(oq.BENCH_QUERIES),
    "conversation_search": oq.search_sql(oq.CONV_QUERIES),
    "benchmark_stats": oq.stats_sql(oq.BENCH_QUERIES),
    "histogram_order": oq.histogram_order_sql(),
    "stored_search": oq.search_sql(oq.BENCH_QUERIES),
    "knn_indexed": oq.search_sql(oq.BENCH_QUERIES),
    "nearest_bodies": oq.nearest_bodies_sql(),
    "search_one": oq.search_sql(oq.ONE_QUERIES),
    "search_edge": oq.search_edge_sql(),
    "stats_edge": oq.stats_edge_sql(),
    "pca_checks": oq.pca_checks_sql(),
    "pca_keys": oq.pca_keys_sql(),
    "pca_variance": oq.pca_variance_sql(),
    "pca_subspace": oq.pca_variance_sql(),
    "pca_search": oq.pca_search_sql(),
    "pca_stats": oq.pca_stats_sql(),
    "doc_means": oq.doc_means_sql(),
    "corpus_scan": oq.corpus_scan_sql(),
    "record_files": oq.records_sql(),
    "label_nearest": oq.label_nearest_sql(),
    "dim_mean": oq.dim_mean_sql(),
    "covariance": oq.covariance_sql(),
    "centered_keys": oq.centered_keys_sql(),
    "label_knn": oq.label_knn_sql(),
    "label_histogram": oq.label_histogram_sql(),
}
