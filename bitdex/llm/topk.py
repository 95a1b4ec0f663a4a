"""Exact top-k inner product search, a block of documents at a time.

The index: vectors of integer terms (a term is a component) are ordered so that like vectors
are neighbours (by the nearest of some pivots, then by the product with it), and every
``BLOCK`` neighbours form a document-range block. A block row holds the largest and the
smallest value of each term and a forward index: the vectors themselves with their ids.

The search, for a group of queries that fits in memory:

1. a query's bound for a block is the sum over its terms of what the term can add at most
   (value times the block's maximum, or times its minimum where the value is negative).
   Reading only the bounds, each query finds the ``SEED`` blocks of highest bound;
2. those blocks are scored, which gives every query a score that its k-th best reaches;
3. every partition of the index takes a query's blocks in order of falling bound, in waves of
   1, 2, 4.. blocks, scores them through the forward index and raises the query's k-th best
   score, until the next bound falls below it. Equal bounds are scored: ties count;
4. the best of all partitions are merged.

Only blocks whose bound is below a score that k candidates reach are left out, so the result
is exact. Pivots are ``PIVOTS`` rows; they only decide the order of the rows.

Scores are exact integers; one that passes 64 bits stands at the end of the range. Vectors
that are null or hold a null or non-finite component take no part; of two vectors of unlike
length the shorter one's missing components add nothing.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches, table

TOP = 5
BLOCK = 32                   # vectors of a block
PIVOTS = 256                 # rows that order the others
SEED = 4                     # blocks scored for a first k-th best score
QUERY_BYTES = 32 << 20       # of the queries that a task holds at a time
SLICE = 4096                 # queries whose bounds are worked out at a time
EXACT = float(1 << 53)       # integers below are exact as doubles
END = (1 << 63) - 1
NO_ID = np.int64(END)        # stands for a null id in order: after all others


def integer_terms(col: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as double; null if the vector can't take part."""
    fine = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(col.isNotNull() & fine,
                  F.transform(col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact and cut at the ends of 64 bits."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.abs(x).max() * np.abs(y).max() * d < EXACT:
        return (x @ y.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -END - 1, END).astype(np.int64)


def bounds(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """What a vector of each block can score at most: (queries, blocks)."""
    d = min(queries.shape[1], hi.shape[1])
    q = queries[:, :d]
    # one product, so that sums past 64 bits are cut once, as scores are
    return dots(np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1),
                np.concatenate([hi[:, :d], lo[:, :d]], axis=1))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of longs as rows, short ones filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = values
    return out


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int64()))


def _nearest(pivots: np.ndarray):
    """Adds each row's pivot and the product with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2))
            score = dots(v, pivots)
            best = score.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best.astype(np.int32)), pa.array(score[np.arange(len(v)), best])],
                names=[*batch.schema.names, "pivot", "near"])
    return run


def _blocks(size: int):
    """Runs of ``size`` rows as blocks: bounds and forward index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            v = matrix(batch.column(2))
            row = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).fill_null(END).to_numpy(zero_copy_only=False)
            cuts = [slice(i, i + size) for i in range(0, len(v), size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(len(cuts))),
                 _lists([v[c].min(axis=0) for c in cuts]), _lists([v[c].max(axis=0) for c in cuts]),
                 _lists([v[c].ravel() for c in cuts]), _lists([ids[c] for c in cuts]),
                 _lists([row[c] for c in cuts])],
                names=["block", "lo", "hi", "forward", "ids", "rows"])
            number += len(cuts)
    return run


def build_blocks(vectors: DataFrame, size: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """The written block table of ``vectors`` (row, vec_id, v)."""
    few = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(pivots).toArrow()["v"].combine_chunks()
    dealt = vectors.withColumns({"pivot": F.lit(0), "near": F.lit(0).cast("long")})
    if len(few):
        dealt = vectors.transform(map_batches, _nearest(matrix(few)),
                                  "row long, vec_id long, v array<bigint>, pivot int, near long")
    order = ["pivot", "near", "row"]
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(dealt.transform(
        map_batches, _blocks(size), "block long, lo array<bigint>, hi array<bigint>, "
        "forward array<bigint>, ids array<bigint>, rows array<bigint>"), "blocks")


def _first(found: list[np.ndarray], top: int) -> list[np.ndarray]:
    """The best ``top`` of each query among (query, score, id, row)."""
    q, score, ids, row = found
    order = np.lexsort((row, ids, -1 - score, q))      # -1 - x: -x has no room at the end
    found = [x[order] for x in found]
    new = np.flatnonzero(np.concatenate([[True], found[0][1:] != found[0][:-1]])[:len(order)])
    place = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return [x[place < top] for x in found]


class Best:
    """The best candidates of some queries so far, and their k-th score."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, kth: np.ndarray, top: int):
        self.queries, self.rows, self.kth, self.top = queries, rows, kth.copy(), top
        self.found = [np.zeros(0, np.int64) for _ in range(4)]
        self.new: list = []

    def score(self, q: np.ndarray, forward: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Score one block for the queries ``q``; what can't be among the best is dropped."""
        s = dots(self.queries[q], forward)
        i, j = np.nonzero((s >= self.kth[q][:, None]) & (self.rows[q][:, None] != rows[None, :]))
        if len(i):
            self.new.append([q[i], s[i, j], ids[j], rows[j]])

    def settle(self) -> None:
        """Merge what was scored since and raise the k-th scores."""
        if not self.new:
            return
        self.found = _first([np.concatenate(x) for x in zip(self.found, *self.new)], self.top)
        self.new = []
        q, score = self.found[:2]
        last = np.flatnonzero(np.concatenate([q[1:] != q[:-1], [True]]))
        full = last[np.diff(np.concatenate([[-1], last])) == self.top]
        self.kth[q[full]] = np.maximum(self.kth[q[full]], score[full])

    def batch(self) -> pa.RecordBatch:
        q, score, ids, row = self.found
        return pa.RecordBatch.from_arrays(
            [pa.array(self.rows[q]), pa.array(score), pa.array(ids), pa.array(row)],
            names=["q", "score", "vec_id", "row"])


FOUND = "q long, score long, vec_id long, row long"


def _forward(batch: pa.RecordBatch, names: list[str]) -> list[tuple[np.ndarray, ...]]:
    """(forward, ids, rows) of each block of a batch."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    flat = [(c.flatten().to_numpy(zero_copy_only=False), c.offsets.to_numpy() - c.offsets[0].as_py())
            for c in columns]
    out = []
    for b in range(batch.num_rows):
        forward, ids, rows = (x[o[b]:o[b + 1]] for x, o in flat)
        out.append((forward.reshape(len(ids), -1), ids, rows))
    return out


def _highest(shared, seed: int):
    """(q, block, bound): each query's blocks of highest bound in a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, queries, _ = shared.value
        best = None
        for batch in batches:
            lo, hi = matrix(batch.column(1)), matrix(batch.column(2))
            block = batch.column(0).to_numpy(zero_copy_only=False)
            for s in range(0, len(rows), SLICE):
                b = bounds(queries[s:s + SLICE], lo, hi)
                keep = np.argsort(-1 - b, axis=1, kind="stable")[:, :seed]
                found = [np.repeat(np.arange(s, s + len(b)), keep.shape[1]),
                         np.take_along_axis(b, keep, axis=1).ravel(), block[keep].ravel(), block[keep].ravel()]
                best = found if best is None else [np.concatenate(x) for x in zip(best, found)]
            if best is not None and len(best[0]) > 4 * seed * len(rows):
                best = _first(best, seed)
        if best is not None:
            q, bound, block, _ = _first(best, seed)
            yield pa.RecordBatch.from_arrays([pa.array(rows[q]), pa.array(block), pa.array(bound)],
                                             names=["q", "block", "bound"])
    return run


def _seeds(shared, top: int):
    """The best candidates of each block for the queries that asked for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, queries, kth = shared.value
        place = np.argsort(rows)
        for batch in batches:
            best = Best(queries, rows, kth, top)
            for asked, block in zip(batch.column(0), _forward(batch, ["forward", "ids", "rows"])):
                asked = asked.values.to_numpy(zero_copy_only=False)
                best.score(place[np.searchsorted(rows, asked, sorter=place)], *block)
            best.settle()
            yield best.batch()
    return run


def _search(shared, top: int):
    """The best candidates of each query in a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, queries, kth = shared.value
        best = Best(queries, rows, kth, top)
        for batch in batches:
            lo, hi = matrix(batch.column(1)), matrix(batch.column(2))
            blocks = _forward(batch, ["forward", "ids", "rows"])
            for s in range(0, len(rows), SLICE):
                bound = bounds(queries[s:s + SLICE], lo, hi)
                order = np.argsort(-1 - bound, axis=1, kind="stable")
                alive, at, wave = np.arange(len(bound)), 0, 1
                while len(alive) and at < len(blocks):
                    now = order[alive, at:at + wave]
                    needed = np.take_along_axis(bound[alive], now, axis=1) >= best.kth[s + alive][:, None]
                    q, b = np.repeat(alive, needed.sum(axis=1)), now[needed]
                    by = np.argsort(b, kind="stable")
                    q, b = q[by] + s, b[by]
                    for one in np.split(np.arange(len(b)), np.flatnonzero(np.diff(b)) + 1):
                        if len(one):
                            best.score(q[one], *blocks[b[one[0]]])
                    best.settle()
                    alive = alive[needed[:, -1]]        # bounds fall: a query's later blocks can't matter
                    at, wave = at + wave, 2 * wave
        yield best.batch()
    return run


def _group(blocks: DataFrame, queries: DataFrame, top: int, seed: int) -> DataFrame:
    """(q, score, vec_id, row): the best ``top`` of each query of a group, and more."""
    spark = blocks.sparkSession
    got = queries.select("row", "v").toArrow().combine_chunks()
    rows = got["row"].to_numpy()
    terms = matrix(got["v"].combine_chunks()) if len(rows) else np.zeros((0, 0), np.int64)
    none = np.full(len(rows), -END - 1, np.int64)
    first = spark.sparkContext.broadcast((rows, terms, none))
    highest = blocks.select("block", "lo", "hi").transform(
        map_batches, _highest(first, seed), "q long, block long, bound long")
    w = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    asked = (highest.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= seed)
             .groupBy("block").agg(F.collect_list("q").alias("asked")))     # at most the group's queries
    seeds = blocks.join(asked, "block").select("asked", "forward", "ids", "rows").transform(
        map_batches, _seeds(first, top), FOUND)
    w = Window.partitionBy("q").orderBy(F.desc("score"))
    kth = (seeds.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == top)
           .select("q", "score").toArrow().combine_chunks())                # a row a query
    at = np.argsort(rows)
    none[at[np.searchsorted(rows, kth["q"].to_numpy(), sorter=at)]] = kth["score"].to_numpy()
    shared = spark.sparkContext.broadcast((rows, terms, none))
    return blocks.transform(map_batches, _search(shared, top), FOUND)


def top_products(vectors: DataFrame, is_query: Column, top: int = TOP, id: str = "vec_id",
                 vector: str = "embedding", scale: int = 256, block: int = BLOCK, pivots: int = PIVOTS,
                 seed: int = SEED, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` holds for, the ``top``
    other rows of highest inner product of floor(``scale`` * x), ties to the smaller id (null last),
    then to the earlier row.

    Rows of one id stay apart: each is a query of its own, and only the very row is left out. A
    null id is a candidate like others. Rows that can't take part (see above) are neither; a
    query without other rows has no result. An empty vector scores 0. An empty table gives no
    rows. Other columns play no part."""
    terms = integer_terms(F.col(vector), scale)
    rows = cut_lineage(vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("vec_id"), terms.alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks")).filter("v IS NOT NULL"), "vectors")
    asking = rows.filter("asks").select("row", "vec_id", "v")
    blocks = build_blocks(rows.select("row", "vec_id", "v"), block, pivots)
    size = asking.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    groups = max(1, math.ceil(size.n * 8 * max(1, size.d or 0) / query_bytes))
    parts = []
    for g in range(groups):
        own = asking if groups == 1 else asking.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == g)
        found = _group(blocks, own, max(1, top), seed)
        parts.append(found if groups == 1 else cut_lineage(found, "found"))
    found = functools.reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, top))
    names = rows.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"))
    theirs = rows.select("row", F.col("vec_id").alias("_id"))
    return best.drop("vec_id").join(names, "q").join(theirs, "row").select(
        "query_id", "rank", F.col("_id").alias("vec_id"), "score")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest products of every 50th embedding."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_products(vectors, F.col("vec_id") % 50 == 0)
