"""Shared bits of the training-data operators: table access, row keys, partition counts."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"          # what separates words
WORD = r"[^\x20\x09-\x0D]+"          # a word


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row's id and text: rows that agree in both share it."""
    return F.xxhash64(*cols)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


BROADCAST_KEYS = 1_000_000       # 64-bit keys that are broadcast; more meet by a shuffle


def by_key(docs: DataFrame, key: Column, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose key is in ``keys`` (left_semi) or not (left_anti). ``keys``: one
    written column of distinct 64-bit keys, counted before it is broadcast."""
    name = keys.columns[0]
    keys = keys.select(F.col(name).alias("_by_key"))
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return docs.withColumn("_by_key", key).join(keys, "_by_key", how).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def cut_by(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """``df`` written in folders by ``columns`` (reading one value reads one folder), and read back."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"bitdex-{spark.sparkContext.applicationId}",
                        f"{name}-{uuid.uuid4().hex}")
    df.write.partitionBy(*columns).parquet(path)
    return spark.read.schema(df.schema).parquet(path)          # also where no row was written


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage now: Spark deletes the shuffle files of plans that nobody
    holds any more only then, and the steps of a loop would pile theirs up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20            # of an Arrow batch between the JVM and a Python worker (or one row)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of at most ``BATCH_BYTES`` (a lower setting of the
    session stays), after which the worker gives its freed memory back: workers wait for the next
    task beside the executor's heap."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_KEY).rstrip("b")) > BATCH_BYTES:
        conf.set(BATCH_KEY, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return df.mapInArrow(tidy, schema)
