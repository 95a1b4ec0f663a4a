"""Dense ordinals and exact samples (R1, C3): rows numbered 0..n-1 in a stated order, the same
however the input is split, and draws with replacement from those numbers.

Numbering: the rows are dealt by ranges of the order, sorted inside, and written with their
place in the range; each range is counted, and what its predecessors hold is added.
No task sees more than a range; the driver sees one count for each of them.

Draws: the i-th number of a linear congruential sequence decides the i-th draw. The
sequence can be entered anywhere (``jump``), so blocks of draws are made by independent tasks,
and the sample depends on the seed, the number of rows and the cap alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

# The multiplier, increment and start of the draws, and the bits that a draw
# leaves out (the low ones).
DRAW_MULTIPLIER = 6364136223846793005
DRAW_INCREMENT = 1442695040888963407
DRAW_SEED = 0x9E3779B97F4A7C15
DRAW_SHIFT = 33

MODULUS = 1 << 64
BLOCK = 1 << 16              # draws of a task's step
PLACE_BITS = 33              # low bits of Spark's monotonically increasing id: the place in a partition


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with its rows' numbers 0..n-1, in the order of its partitions and of the rows in them."""
    rows = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_at", PLACE_BITS)
    counts = rows.groupBy(part.alias("_part")).count().orderBy("_part").collect()     # one for each partition
    before = itertools.accumulate((r["count"] for r in counts), initial=0)
    start = df.sparkSession.createDataFrame(
        [(r["_part"], b) for r, b in zip(counts, before)], "_part long, _before long")
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (rows.withColumn("_part", part).join(F.broadcast(start), "_part")
            .withColumn(name, F.col("_before") + place).drop("_at", "_part", "_before"))


def dense_ordinal(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """``df`` with ``name``: 0..n-1 in the order of the columns ``order`` (nulls first). Rows that agree
    in all of them are numbered in any order."""
    return numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def jump(state: int, steps: int) -> int:
    """The state of the sequence ``steps`` later."""
    mul, add = DRAW_MULTIPLIER, DRAW_INCREMENT           # of 2**b steps
    while steps:
        if steps & 1:
            state = (state * mul + add) % MODULUS
        mul, add = mul * mul % MODULUS, (mul + 1) * add % MODULUS
        steps >>= 1
    return state


def draw_block(n: int, first: int, count: int, seed: int = DRAW_SEED) -> np.ndarray:
    """Draws ``first`` .. ``first + count - 1`` of numbers below ``n``."""
    start = np.uint64(jump(seed, first))
    powers = np.multiply.accumulate(np.full(count, DRAW_MULTIPLIER, np.uint64))       # a, a^2, ..
    sums = np.cumsum(np.concatenate([[np.uint64(1)], powers[:-1]]), dtype=np.uint64)  # 1, 1 + a, ..
    states = start * powers + np.uint64(DRAW_INCREMENT) * sums
    return ((states >> np.uint64(DRAW_SHIFT)) % np.uint64(n)).astype(np.int64)


def draws(spark: SparkSession, n: int, cap: int, seed: int = DRAW_SEED) -> DataFrame:
    """(row, times): ``cap`` draws with replacement from 0..n-1, equal ones counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                first = b * BLOCK
                row, times = np.unique(draw_block(n, first, min(BLOCK, cap - first), seed), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(times)], names=["row", "times"])

    blocks = spark.range(-(-cap // BLOCK)) if n > 0 else spark.range(0)
    return blocks.mapInArrow(run, "row long, times long").groupBy("row").agg(F.sum("times").alias("times"))


def sample_exact(rows: DataFrame, cap: int, seed: int = DRAW_SEED) -> DataFrame:
    """``rows`` (with a dense ``row``) if they are at most ``cap``; else exactly ``cap`` of them drawn
    with replacement, a row as often as it was drawn."""
    n = rows.count()
    if n <= cap:
        return rows
    got = rows.join(draws(rows.sparkSession, n, cap, seed), "row")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_copy")
    return got.select(*[F.col(f"`{c}`") for c in rows.columns], copies).drop("_copy")
