"""Exact nearest keys through an index of 16-bit blocks.

A ``k``-bit key has ``m = ceil(k / 16)`` blocks. If two keys are within distance
``m * (s + 1) - 1``, some block of theirs differs in at most ``s`` bits (pigeonhole). So a
query looks up, for ``s = 0, 1, ..``, the values of each block at block distance ``s`` from its
own, and has then met every key within that distance: once its ``top``-th best is that near, it
is *settled* and the result is exact, ties included.

The stored form (``build_buckets``) has ``m`` rows for each key, one for each block value, with the whole
key, laid out in a folder for each block and the leading bits of its value, so that a look-up
opens the folders of its values only. ``bucket_sizes`` (at most ``m * 65536`` numbers) says what a
look-up will read.

First of all, the bucket of a query's first block is searched for keys equal to its own, by a join on
the whole key: a query with ``top`` of them or more is settled, and nothing else in its buckets was met. So
copies and look-ups of stored keys cost a row each, however many keys share a block value.

A batch of queries goes up level by level. The look-ups of a level are as large as the
number of values at that distance, and grow fast with it, so a query leaves for the
full scan (``search.knn``) as soon as its next level would meet more than ``share`` of all
keys: near queries read a few buckets, far ones are not made dearer than the scan.

Look-ups are broadcast in groups of at most ``PROBES`` rows, and stream past the buckets without a
shuffle of the index. A pair is reported by the first block that is nearest, so none comes twice.
"""

from __future__ import annotations

import functools
import itertools
import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as kx
from ..session import cut_lineage
from . import search as sr

BITS = 16                    # of a block
FOLDER_BITS = 4              # leading bits of a value that name its folder
SHARE = 0.25                 # of all keys that a query's next level may meet
PROBES = 1_000_000           # look-ups broadcast at a time
VALUES = 1_000_000           # block values that a task holds at a time
EQUAL = -2                   # level of the report for the search of equal keys


def n_blocks(k: int) -> int:
    return -(-k // BITS)


def block_values(k: int, prefix: str = "w") -> list[Column]:
    """The value of each block; a last block of fewer bits ends in zeros, as the words do."""
    per = 64 // BITS
    return [F.shiftrightunsigned(F.col(f"{prefix}{j // per}"), 64 - BITS * (j % per + 1))
            .bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") for j in range(n_blocks(k))]


def balls() -> list[list[int]]:
    """XOR masks of a block by distance: ``balls()[s]`` has the masks with ``s`` bits."""
    return [[sum(1 << b for b in bits) for bits in itertools.combinations(range(BITS), s)]
            for s in range(BITS + 1)]


class Buckets(NamedTuple):
    """The block rows (block, folder, value, row, ord, w0..), and how many have each value."""
    rows: DataFrame
    sizes: DataFrame
    k: int


def build_buckets(index: DataFrame, k: int) -> DataFrame:
    """(block, folder, value, row, ord, w0..): ``n_blocks(k)`` rows for each whole key."""
    values = F.array(*[F.struct(F.lit(j).alias("block"), v.alias("value"))
                       for j, v in enumerate(block_values(k))])
    rows = sr._scanned(index, k).select("row", "ord", *kx.word_cols(k), F.explode(values).alias("b"))
    return rows.select("b.block", F.shiftright("b.value", BITS - FOLDER_BITS).alias("folder"), "b.value",
                       "row", "ord", *kx.word_cols(k))


def write_buckets(index: DataFrame, k: int, root: str) -> Buckets:
    """Write the buckets and their sizes under ``root``. Rows are dealt by ranges of (block, value,
    row), so a value that many keys share is split as well."""
    spark = index.sparkSession
    (build_buckets(index, k).repartitionByRange("block", "value", "row").sortWithinPartitions("block", "folder", "value")
     .write.mode("overwrite").partitionBy("block", "folder").parquet(f"{root}/buckets"))
    rows = _rows(spark, k, root)
    (rows.groupBy("block", "value").agg(F.count("*").alias("n"))
     .write.mode("overwrite").parquet(f"{root}/bucket_sizes"))
    return read_buckets(spark, k, root)


def _rows(spark: SparkSession, k: int, root: str) -> DataFrame:
    words = ", ".join(f"{w} long" for w in kx.word_cols(k))
    return spark.read.schema(f"value int, row long, ord long, {words}, block int, folder int").parquet(f"{root}/buckets")


def read_buckets(spark: SparkSession, k: int, root: str) -> Buckets:
    return Buckets(_rows(spark, k, root),
                   spark.read.schema("block int, value int, n long").parquet(f"{root}/bucket_sizes"), k)


def _size_array(b: Buckets) -> np.ndarray:
    """Keys of each (block, value), on the driver: ``n_blocks * 65536`` numbers, whatever the index."""
    got = b.sizes.toPandas()
    out = np.zeros((n_blocks(b.k), 1 << BITS), np.int64)
    out[got["block"].to_numpy(), got["value"].to_numpy()] = got["n"].to_numpy()
    return out


def _pieces(pdf: pd.DataFrame, masks: int) -> list[pd.DataFrame]:
    """The rows of a batch, so many at a time that their block values at a level are at most ``VALUES``."""
    step = max(1, VALUES // masks)
    return [pdf.iloc[at:at + step] for at in range(0, len(pdf), step)]


def _priced(queries: DataFrame, k: int, sizes, level: int, blocks: int | None = None) -> DataFrame:
    """``queries`` with ``probes`` (values of this level that some key has) and ``meets`` (keys there), in the
    first ``blocks`` blocks (all, by default)."""
    masks = np.array(balls()[level], np.int64)
    m = blocks or n_blocks(k)
    fields = queries.schema.simpleString()[7:-1]

    def run(batches):
        n = sizes.value
        for whole in batches:
            for pdf in _pieces(whole, len(masks)):
                values = np.stack([pdf[f"v{j}"].to_numpy(np.int64) for j in range(m)], axis=1)
                probes, meets = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
                for j in range(m):
                    found = n[j][values[:, j, None] ^ masks[None, :]]
                    probes += (found > 0).sum(axis=1)
                    meets += found.sum(axis=1)
                yield pdf.drop(columns=[f"v{j}" for j in range(m)]).assign(probes=probes, meets=meets)

    with_values = queries.select("*", *[v.alias(f"v{j}") for j, v in enumerate(block_values(k)[:m])])
    return with_values.mapInPandas(run, f"{fields.replace(':', ' ')}, probes long, meets long")


def _lookups(queries: DataFrame, k: int, sizes, level: int) -> DataFrame:
    """(q, w0.., block, value) of a level's look-ups; values that no key has are left out."""
    masks = np.array(balls()[level], np.int64)
    m, words = n_blocks(k), kx.word_cols(k)

    def run(batches):
        n = sizes.value
        for whole in batches:
            for pdf, j in itertools.product(_pieces(whole, len(masks)), range(m)):
                values = pdf[f"v{j}"].to_numpy(np.int64)[:, None] ^ masks[None, :]
                i, at = np.nonzero(n[j][values])
                yield pd.DataFrame({c: pdf[c].to_numpy()[i] for c in ["q", *words]}
                                   | {"block": np.full(len(i), j, np.int32), "value": values[i, at].astype(np.int32)})

    with_values = queries.select("q", *words, *[v.alias(f"v{j}") for j, v in enumerate(block_values(k))])
    return with_values.mapInPandas(run, "q long, " + ", ".join(f"{w} long" for w in words) + ", block int, value int")


def _met(b: Buckets, lookups: DataFrame, level: int) -> DataFrame:
    """(q, row, ord, dist) of the keys in the looked-up buckets whose nearest block is this one, the first
    of equals."""
    k, words = b.k, kx.word_cols(b.k)
    lookups = lookups.withColumn("folder", F.shiftright("value", BITS - FOLDER_BITS))
    touched = [(r["block"], r["folder"]) for r in lookups.select("block", "folder").distinct().collect()]
    by_block: dict[int, list[int]] = {}
    for block, folder in touched:                         # at most n_blocks * 2**FOLDER_BITS
        by_block.setdefault(block, []).append(folder)
    opened = [(F.col("block") == j) & F.col("folder").isin(sorted(f)) for j, f in sorted(by_block.items())]
    rows = b.rows.filter(functools.reduce(Column.__or__, opened) if opened else F.lit(False))
    asked = lookups.select("q", "block", "folder", "value", *[F.col(w).alias(f"_{w}") for w in words])
    pairs = rows.join(F.broadcast(asked), ["block", "folder", "value"])
    xor = [F.col(w).bitwiseXOR(F.col(f"_{w}")).alias(f"x{i}") for i, w in enumerate(words)]
    pairs = pairs.select("q", "row", "ord", "block", *xor)
    apart = [F.bit_count(v) for v in block_values(k, "x")]
    nearest = functools.reduce(lambda a, c: F.least(a, c), apart) if len(apart) > 1 else apart[0]
    first = functools.reduce(lambda other, j: F.when(apart[j] == level, j).otherwise(other),
                             reversed(range(len(apart))), F.lit(-1))
    dist = functools.reduce(Column.__add__, [F.bit_count(f"x{i}") for i in range(len(words))])
    return pairs.filter((nearest == level) & (first == F.col("block"))).select("q", "row", "ord", dist.cast("int").alias("dist"))


def _equal(b: Buckets, asking: DataFrame, top: int) -> DataFrame:
    """(q, row, ord, dist) of the first ``top`` keys equal to each query's own. Both are in the bucket of the
    query's first block; the join is on the whole key, so no other key of the bucket is paired."""
    words = kx.word_cols(b.k)
    asked = asking.select("q", block_values(b.k)[0].alias("value"), *words)
    rows = b.rows.filter(F.col("block") == 0).select("value", *words, "row", "ord")
    met = rows.join(asked.select("value", *words).distinct(), ["value", *words], "left_semi")
    w = Window.partitionBy("value", *words).orderBy("ord", "row")
    first = met.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= top)
    return asked.join(first, ["value", *words]).select("q", "row", "ord", F.lit(0).alias("dist"))


def _best(found: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy("dist", "ord", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def knn_indexed(index: DataFrame, buckets: Buckets, qkeys: DataFrame, top: int = sr.DEFAULT_TOP,
                share: float = SHARE, probes: int = PROBES) -> tuple[DataFrame, DataFrame]:
    """((qid, q, rank, row, ord, dist) as ``search.knn`` gives it, report).

    The report has a row for each level, one for equal keys (level ``EQUAL``) and one for the scan
    (level -1): queries that took part, rows that their look-ups met, queries settled. A query whose next level would meet more than
    ``share`` of the keys, or that no level settles, is answered by the scan of ``index``."""
    k, spark = buckets.k, index.sparkSession
    top, m = max(1, int(top)), n_blocks(k)
    numbered = qkeys if "q" in qkeys.columns else sr.number_queries(qkeys, k)
    array = _size_array(buckets)
    n = int(array[0].sum())
    sizes = spark.sparkContext.broadcast(array)
    active = numbered.select("q", *kx.word_cols(k))
    best = spark.createDataFrame([], "q long, row long, ord long, dist int, rank int")
    done, scanned, report = [], [], []
    asking = cut_lineage(_priced(active, k, sizes, 0, 1).filter(F.col("meets") <= share * n), "asking")
    equal = cut_lineage(_best(_equal(buckets, asking, top), top), "equal")
    full = cut_lineage(equal.filter(F.col("rank") == top).select("q"), "settled")
    report.append((EQUAL, asking.count(), equal.count(), full.count()))
    done.append(equal.join(full, "q", "left_semi"))
    active = active.join(full, "q", "left_anti")
    for level in range(BITS + 1):
        priced = cut_lineage(_priced(active, k, sizes, level), "priced")
        near = F.col("meets") <= share * n
        size = priced.agg(F.count_if(near).alias("n"), F.sum(F.when(near, F.col("probes"))).alias("p"),
                          F.sum(F.when(near, F.col("meets"))).alias("meets")).first()
        scanned.append(priced.filter(~near).select("q"))
        if not size.n:
            break
        asking = priced.filter(near)
        groups = max(1, math.ceil(2 * size.p / probes)) if (size.p or 0) > probes else 1
        part = F.pmod(F.xxhash64("q"), F.lit(groups))
        found = [_best(_met(buckets, _lookups(asking.filter(part == g) if groups > 1 else asking, k, sizes, level), level),
                       top).select("q", "row", "ord", "dist") for g in range(groups)]
        if groups > 1:
            found = [cut_lineage(f, "met") for f in found]
        found = functools.reduce(DataFrame.unionByName, found)
        best = cut_lineage(_best(best.drop("rank").unionByName(found).join(asking.select("q"), "q", "left_semi"), top), "best")
        full = best.filter((F.col("rank") == top) & (F.col("dist") <= m * (level + 1) - 1)).select("q")
        report.append((level, size.n, size.meets or 0, full.count()))
        done.append(best.join(full, "q", "left_semi"))
        active = asking.select("q", *kx.word_cols(k)).join(full, "q", "left_anti")
        if level == BITS:                                  # all keys were met: there are less than ``top``
            done.append(best.join(active.select("q"), "q", "left_semi"))
    rest = functools.reduce(DataFrame.unionByName, scanned)
    rest = cut_lineage(numbered.join(rest, "q", "left_semi"), "rest")
    left = rest.count()
    report.append((-1, left, left * n, left))
    columns = ["q", "rank", "row", "ord", "dist"]
    if left:
        done.append(sr.knn(index, rest, k, top).select(*columns))
    hits = functools.reduce(DataFrame.unionByName, [d.select(*columns) for d in done]) if done else \
        spark.createDataFrame([], "q long, rank int, row long, ord long, dist int")
    result = hits.join(numbered.select("q", "qid"), "q").select("qid", *columns)
    return result, spark.createDataFrame(report, "level int, queries long, met long, settled long")
