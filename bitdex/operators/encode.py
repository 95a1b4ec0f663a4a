"""Encoders: text -> unit vector.

An encoder is any object with

* ``dim`` -- output width;
* ``encode_batch(texts) -> np.ndarray`` of shape ``(len(texts), dim)``, one
  L2-normalised row per text, a zero row for null/empty/token-less text;
* optionally ``column(text_col) -> Column``, a pure Spark SQL expression that
  computes the same vector inside the JVM.

or an ``EncoderSource``, which names such an object and loads it inside each
Python worker, once per worker. Either may be defined in a script or notebook.

``embed`` uses the JVM expression when there is one, otherwise an Arrow UDF that
calls ``encode_batch`` on ``SLICE`` rows at a time, so that what a worker holds beside a
batch and its vectors doesn't follow the batch.

The built-in ``HashPoolEncoder`` is a lexical stand-in for a sentence model
(random-hyperplane hashing of tokens): each basic token ``t`` gets the
``dim`` bits of ``md5("0:" t) || md5("1:" t) || ...`` mapped to +1/-1, the
vectors of a text's tokens (all of them; a limit is an option) are summed and
the sum is L2-normalised. It is deterministic and needs no model file; it is *not* a
semantic encoder.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import vectors as vx

DEFAULT_DIM = 384
# Tokens whose bits are gathered at a time (x dim bytes), and texts that are summed at a time.
TOKEN_CHUNK = 8_192
TEXT_CHUNK = 2_048
# Rows that are encoded or projected at a time.
SLICE = 1_024
# Tokens whose bits a worker keeps (x dim bytes), and their characters at most.
TABLE_ROWS = 65_536
TABLE_CHARS = 4_000_000
# Rows of bits that a byte can count.
BYTE_MAX = 255


class _Rows(dict):
    """Row of each token; ``new`` has the tokens that got one since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self.new.append(token)
        row = self[token] = len(self)
        return row


class BitTable:
    """The ``dim`` bits of the tokens met so far, a byte each: a token that comes again is not hashed
    again. It starts anew when it is full, so its size is bounded whatever the vocabulary."""

    def __init__(self, dim: int):
        self.dim = dim
        self.bits = np.empty((TABLE_ROWS, dim), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.rows, self.chars = _Rows(), 0

    def gather(self, tokens: list[str]) -> np.ndarray:
        """(len(tokens), dim) bits; at most ``TABLE_ROWS`` tokens."""
        if len(self.rows) + len(tokens) > TABLE_ROWS or self.chars > TABLE_CHARS:
            self.clear()
        first, rows = len(self.rows), self.rows
        codes = np.fromiter(map(rows.__getitem__, tokens), np.int64, len(tokens))
        if rows.new:
            heads = [f"{g}:".encode() for g in range(self.dim // 128)]
            digests = b"".join(hashlib.md5(h + t).digest() for t in map(str.encode, rows.new) for h in heads)
            self.bits[first:len(rows)] = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, self.dim)
            self.chars += sum(map(len, rows.new))
            rows.new = []
        return self.bits[codes]


_TABLES: dict[int, BitTable] = {}


def _bit_table(dim: int) -> BitTable:
    if dim not in _TABLES:
        _TABLES[dim] = BitTable(dim)
    return _TABLES[dim]


def count_bits(bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ones of each column in the rows from each start to the next. Eight columns are added at a time, as the
    bytes of one word, over at most ``BYTE_MAX`` rows, so no byte overflows."""
    lengths = np.diff(np.append(starts, len(bits)))
    parts = -(-lengths // BYTE_MAX)
    before = np.cumsum(parts) - parts
    at = np.repeat(starts, parts) + BYTE_MAX * (np.arange(parts.sum()) - np.repeat(before, parts))
    ones = np.add.reduceat(bits.view(np.uint64), at, axis=0).view(np.uint8).astype(np.int32)
    return ones if len(ones) == len(starts) else np.add.reduceat(ones, before, axis=0)


class HashPoolEncoder:
    """md5 sign-hash of each token, summed over the text, L2-normalised."""

    # The Arrow batch path is ~9x faster than the interpreted higher-order
    # functions of ``column`` (measured on 1,000 bodies), so it is the default;
    # ``mode="jvm"`` selects the expression.
    prefer_jvm = False

    def __init__(self, dim: int = DEFAULT_DIM,
                 max_tokens: int | None = None):
        if dim % 128 != 0 or dim <= 0:
            raise ValueError("HashPoolEncoder dim must be a multiple of 128")
        self.dim = dim
        self.max_tokens = max_tokens

    # -- JVM form ---------------------------------------------------------
    def token_sums(self, text: Column) -> Column:
        """Integer vector ``s`` with ``s_i = sum_t (2 * bit_i(t) - 1)``."""
        toks = tx.tokenize(text)
        if self.max_tokens is not None:
            toks = F.slice(toks, 1, self.max_tokens)
        groups = self.dim // 128
        dims = F.sequence(F.lit(0), F.lit(self.dim - 1))

        def words(t: Column) -> Column:
            # 4 * groups 32-bit words of the token's md5 digests.
            hashes = F.array(*[F.md5(F.concat(F.lit(f"{g}:"), t))
                               for g in range(groups)])
            return F.flatten(F.transform(hashes, lambda h: F.array(*[
                F.conv(F.substring(h, 8 * j + 1, 8), 16, 10).cast("bigint")
                for j in range(4)])))

        def dim_sum(tw: Column, i: Column) -> Column:
            # bit i is bit 31 - i % 32 of word i // 32 (most significant first)
            word = F.call_function("shiftright", i, F.lit(5)) + 1
            shift = F.lit(31) - i.bitwiseAND(F.lit(31))
            return F.aggregate(tw, F.lit(0), lambda acc, w: acc + F.call_function(
                "shiftright", F.element_at(w, word), shift)
                .bitwiseAND(F.lit(1)).cast("int") * 2 - 1)

        return vx.let(F.transform(toks, words),
                      lambda tw: F.transform(dims, lambda i: dim_sum(tw, i)))

    def column(self, text: Column) -> Column:
        return vx.l2_normalize(self.token_sums(text))

    # -- Python form ------------------------------------------------------
    def sums_batch(self, texts) -> np.ndarray:
        """Integer token sums ``s`` per text (the state before normalising). Sums add
        up, so at most ``TOKEN_CHUNK`` tokens are expanded at a time however long the
        texts are."""
        out = np.zeros((len(texts), self.dim), dtype=np.int64)
        rows, flat, starts = [], [], []
        table = _bit_table(self.dim)

        def add() -> None:
            first = np.array(starts)
            ones = count_bits(table.gather(flat), first)
            counts = np.diff(np.append(first, len(flat)))
            out[rows] += 2 * ones - counts[:, None]
            for x in (rows, flat, starts):
                x.clear()

        for i, text in enumerate(texts):
            toks = py_tokenize(text)[: self.max_tokens] if text else []
            for at in range(0, len(toks), TOKEN_CHUNK):
                part = toks[at:at + TOKEN_CHUNK]
                if flat and (len(flat) + len(part) > TOKEN_CHUNK or len(rows) == TEXT_CHUNK or rows[-1] == i):
                    add()
                rows.append(i)
                starts.append(len(flat))
                flat.extend(part)
        if flat:
            add()
        return out

    def encode_batch(self, texts) -> np.ndarray:
        """Same vectors as ``column``: ``s / sqrt(sum(s * s))``, zero rows for
        texts without tokens."""
        s = self.sums_batch(texts)
        ss = (s * s).sum(axis=1).astype(np.float64)
        out = np.zeros(s.shape, dtype=np.float64)
        nz = ss > 0
        out[nz] = s[nz] / np.sqrt(ss[nz])[:, None]
        return out


# -- plain-Python tokenizer for the batch path ------------------------------
_PY_TOKEN = re.compile(r"[!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~ \t\n\x0b\x0c\r]+")


@lru_cache(maxsize=1)
def _py_fold_map() -> dict[int, str | None]:
    src, dst = tx.fold_table()
    table: dict[int, str | None] = {}
    for i, ch in enumerate(src):
        table[ord(ch)] = dst[i] if i < len(dst) else None
    return table


def py_fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_py_fold_map())


def py_tokenize(text: str) -> list[str]:
    return _PY_TOKEN.findall(py_fold(text))


# -- embed ------------------------------------------------------------------
class EncoderSource:
    """An encoder that is loaded where it is used: ``load()`` runs once in each Python
    worker, under ``name`` (say, a model's path), and the worker keeps one encoder."""

    def __init__(self, name: str, load, dim: int):
        self.name, self.load, self.dim = name, load, dim


_LOADED: dict[str, object] = {}


def loaded(encoder):
    """The encoder itself, or what its source loads."""
    if not isinstance(encoder, EncoderSource):
        return encoder
    if encoder.name not in _LOADED:
        _LOADED.clear()
        _LOADED[encoder.name] = encoder.load()
    return _LOADED[encoder.name]


def list_rows(mat: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an array of lists, without copying them."""
    n, width = mat.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * np.int32(width), pa.array(mat.reshape(-1)))


def encoded(texts, encode, dtype) -> np.ndarray:
    """``encode`` of a batch's texts (an Arrow array), ``SLICE`` rows at a time."""
    out = None
    for at in range(0, len(texts), SLICE):
        mat = np.asarray(encode(texts.slice(at, SLICE).to_pylist()), dtype)
        if out is None:
            out = np.empty((len(texts), mat.shape[1]), dtype)
        out[at:at + len(mat)] = mat
    return np.empty((0, 0), dtype) if out is None else out


def _vector_udf(encoder):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def enc(texts: pa.Array) -> pa.Array:
        return list_rows(encoded(texts, loaded(encoder).encode_batch, np.float64))
    # A barrier for the optimizer: keeps filters from being pushed below the
    # encoder (which would run it twice) and keeps later projections from
    # being inlined into its input.
    return enc.asNondeterministic()


def _use_jvm(encoder, mode: str) -> bool:
    if mode == "python" or not hasattr(encoder, "column"):
        return False
    return mode == "jvm" or getattr(encoder, "prefer_jvm", True)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over ``min_partitions`` tasks (default: the cluster's
    ``defaultParallelism``) before a CPU-heavy step when its estimated bytes fill fewer
    scan partitions (a few large row groups); a no-op on any large corpus. The
    estimate is the optimizer's, so no job runs; the result is the same either way."""
    spark = df.sparkSession
    if min_partitions is None:
        min_partitions = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(min_partitions) if size < min_partitions * split else df


def token_sums_col(text: Column | str, encoder: HashPoolEncoder,
                   mode: str = "auto") -> Column:
    """Integer token sums of the hash-pool encoder (before normalising)."""
    c = F.col(text) if isinstance(text, str) else text
    if mode == "jvm":
        return encoder.token_sums(c)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sums(texts: pa.Array) -> pa.Array:
        return list_rows(encoded(texts, loaded(encoder).sums_batch, np.int64))
    return sums.asNondeterministic()(c)


def _scores_udf(encoder):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scores(titles: pa.Array, arrs: pa.Array) -> pa.Array:
        m = loaded(encoder)
        out = [None] * len(arrs)
        for i in np.flatnonzero(arrs.is_valid().to_numpy(zero_copy_only=False)
                                & titles.is_valid().to_numpy(zero_copy_only=False)):      # one article at a time
            mat = m.encode_batch([titles[i].as_py(), *arrs[i].as_py()])
            # left-to-right sum, as the SQL/higher-order-function dot product
            out[i] = np.add.accumulate(mat[1:] * mat[0], axis=1)[:, -1].copy()      # not a view of the products
        return pa.array(out, pa.list_(pa.float64()))
    return scores.asNondeterministic()


def score_col(title: Column | str, units: Column | str, encoder,
              mode: str = "auto") -> Column:
    """Cosine of every unit's vector with the title's vector (J1 + V3),
    encoded in one Arrow pass; only the scores come back to the JVM."""
    t = F.col(title) if isinstance(title, str) else title
    u = F.col(units) if isinstance(units, str) else units
    if _use_jvm(encoder, mode):
        from ..functions import vectors as vx2
        return vx2.let(encoder.column(t), lambda tv: F.transform(
            u, lambda x: vx2.dot(encoder.column(x), tv)))
    return _scores_udf(encoder)(t, u)


def encode_col(text: Column | str, encoder, mode: str = "auto") -> Column:
    """Vector column for a string column."""
    c = F.col(text) if isinstance(text, str) else text
    if _use_jvm(encoder, mode):
        return encoder.column(c)
    return _vector_udf(encoder)(c)


def embed(df: DataFrame, text_col: str, out_col: str = "vec", encoder=None,
          mode: str = "auto") -> DataFrame:
    """One vector per input row (C2). Put every filter *before* this call:
    Catalyst cannot push a filter on the output through a Python UDF."""
    encoder = encoder or HashPoolEncoder()
    return df.withColumn(out_col, encode_col(text_col, encoder, mode))


class SumsEncoder:
    """The token sums of a hash-pool encoder, before they are normalised, as an encoder."""

    def __init__(self, encoder: HashPoolEncoder):
        self.encoder, self.dim = encoder, encoder.dim

    def encode_batch(self, texts: list[str]) -> np.ndarray:
        return self.encoder.sums_batch(texts)


BATCH_TOKENS = 32_768        # of a batch, each text counted as long as the longest
WITHIN = 0.1                 # by how much the longest text of a batch may exceed the shortest


def even_batches(tokens: np.ndarray, batch_tokens: int = BATCH_TOKENS, within: float = WITHIN) -> list[slice]:
    """Cuts of rising token counts into batches of like texts, of at most ``batch_tokens`` when padded
    (or one text)."""
    out, first = [], 0
    for i in range(1, len(tokens) + 1):
        if i == len(tokens) or tokens[i] > max(1, tokens[first]) * (1 + within) or \
                (i - first + 1) * tokens[i] > batch_tokens:
            out.append(slice(first, i))
            first = i
    return out


def embed_even(df: DataFrame, text_col: str, out_col: str = "vec", encoder=None,
               batch_tokens: int = BATCH_TOKENS, within: float = WITHIN, n_ctx: int | None = None) -> DataFrame:
    """``embed`` for a model whose batches cost rows x longest text (C2): each task takes its rows in order of
    their token counts (at most ``n_ctx`` where the model cuts texts there) and encodes batches of like texts.
    Counts are JVM expressions, the sort is inside a partition, and a row keeps its columns, so nothing has
    to be put back in order. Null texts count and encode as empty ones."""
    encoder = encoder or HashPoolEncoder()
    count = F.coalesce(F.regexp_count(tx.fold_text(text_col), F.lit(tx.TOKEN_PATTERN)), F.lit(0))
    count = count if n_ctx is None else F.least(count, F.lit(n_ctx))
    rows = df.withColumn("_n", count).sortWithinPartitions("_n")
    names = [c for c in df.columns if c != out_col]
    schema = T.StructType([*df.select(*names).schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches):
        m = loaded(encoder)
        for batch in batches:
            texts, counts = batch.column(at), batch.column(len(names)).to_numpy()
            out = None
            for b in even_batches(counts, batch_tokens, within):
                mat = np.asarray(m.encode_batch(
                    [t or "" for t in texts.slice(b.start, b.stop - b.start).to_pylist()]), np.float64)
                out = np.empty((len(counts), mat.shape[1])) if out is None else out
                out[b] = mat
            if out is not None:
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], list_rows(out)], names=[*names, out_col])

    at = names.index(text_col)
    return rows.select(*names, "_n").mapInArrow(run, schema)


def mean_pool(token_vecs: DataFrame, id_col: str, vec_col: str,
              out_col: str = "vec") -> DataFrame:
    """Average of each document's token vectors, then L2-normalised (A5).

    Table form for a token-vector table produced by an external encoder:
    a partial (map-side) + final ``Summarizer.mean`` per document.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    pooled = (token_vecs
              .withColumn("_v", array_to_vector(F.col(vec_col).cast("array<double>")))
              .groupBy(id_col)
              .agg(Summarizer.mean(F.col("_v")).alias("_m")))
    return pooled.select(id_col, vx.l2_normalize(vector_to_array("_m")).alias(out_col))
