"""Index persistence.

Layout under an index directory ``root``:

* loose tables: ``root/index`` (row, ord, id, title, w0..) and ``root/params``
  (one row: dim, k, n_fit, mean, components, explained_variance);
* packed bundles: ``root/bundle/v=<n>/{_claim,index,params,_manifest}``, the index in
  folders by ranges of rows;
* the block index of a bundle (``multi_index``), if asked for:
  ``root/bundle/v=<n>/blocks/{buckets,bucket_sizes,_manifest}``.

Commit protocol: a packer first *claims* a version by renaming a folder of its own to
``v=<n>``, which fails where that exists, and then tries the next. So two packers
at once write two bundles, never into one. The manifest row is written **last**, with the
rows and a checksum of each part as read back from the files; a bundle without it is
incomplete and ignored. Readers take the highest complete version, so re-packing
replaces the earlier pack, and hold its parts against the manifest: a missing or
truncated file is an error, never a reason to serve an older bundle. (The rename must be atomic, as
in HDFS and POSIX file systems; on an object store let one packer run at a time.)

Data is read and written by Spark, names by Hadoop's file system interface, so ``root`` may be any
file system the cluster mounts.
"""

from __future__ import annotations

import re
import uuid
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as kx
from ..operators import multi_index as mi
from ..operators import search as sr
from ..operators.pca import PcaParams


def write_index(index: DataFrame, params: PcaParams, root: str) -> None:
    """Write the loose ``index`` and ``params`` tables."""
    spark = index.sparkSession
    index.write.mode("overwrite").parquet(f"{root}/index")
    params.to_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{root}/params")


def _absent(e: AnalysisException) -> bool:
    """Whether a read failed because nothing is there."""
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


MANIFEST = "version int, n_keys long, dim int, k int, index_sum decimal(38,0), params_sum decimal(38,0)"


def _manifests(spark: SparkSession, root: str) -> list:
    try:
        m = spark.read.schema(MANIFEST).json(f"{root}/bundle/*/_manifest")
        return m.collect()
    except AnalysisException as e:
        if _absent(e):      # no bundle written yet
            return []
        raise


def _claim(spark: SparkSession, root: str) -> int:
    """The next version, for this packer alone."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    bundle = path(f"{root}/bundle")
    fs = bundle.getFileSystem(conf)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def claim():
        made = path(bundle, f"_claim-{uuid.uuid4().hex}")
        fs.create(path(made, "_claim"), False).close()     # not empty: a folder isn't renamed over it
        return made

    own = claim()
    taken = [int(x.getPath().getName()[2:]) for x in fs.listStatus(bundle)
             if re.fullmatch(r"v=\d+", x.getPath().getName())]
    v = max([0, *taken]) + 1
    while True:
        try:
            files.rename(fs.makeQualified(own), fs.makeQualified(path(bundle, f"v={v}")), never_over)
            # a local file system that can't rename it, as another packer was first, copies it into that one's folder
            lost = path(path(bundle, f"v={v}"), own.getName())
            if not fs.exists(lost):
                return v
            fs.delete(lost, True)
            own = claim()
            v += 1
        except Py4JJavaError:
            if not fs.exists(path(bundle, f"v={v}")):
                raise
            v += 1


def _sums(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of the rows' hashes): the same in any order of the rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"] or 0


def _read_loose(spark: SparkSession, root: str):
    try:
        return (spark.read.parquet(f"{root}/index"),
                PcaParams.from_df(spark.read.parquet(f"{root}/params")))
    except AnalysisException as e:
        if _absent(e):
            raise FileNotFoundError(f"missing index or params under {root}; "
                                    f"build the index first") from e
        raise


def _write_bundle(index: DataFrame, params: PcaParams, root: str) -> int:
    """Write the next version: data, params, and the manifest last."""
    spark = index.sparkSession
    missing = [w for w in kx.word_cols(params.k) if w not in index.columns]
    if missing:
        raise ValueError(f"index lacks key columns {missing}")
    v = _claim(spark, root)
    base = f"{root}/bundle/v={v}"
    index = index.drop(sr.RANGE)
    # searches read all folders, hits only those of their rows; one range needs no folder
    if "row" in index.columns and (index.agg(F.max("row")).first()[0] or 0) >= sr.RANGE_ROWS:
        index = index.withColumn(sr.RANGE, sr.range_of("row"))
        index.write.partitionBy(sr.RANGE).parquet(f"{base}/index")
    else:
        index.write.parquet(f"{base}/index")
    params.to_df(spark).coalesce(1).write.parquet(f"{base}/params")
    n_keys, index_sum = _sums(spark.read.parquet(f"{base}/index"))
    _, params_sum = _sums(spark.read.parquet(f"{base}/params"))
    if n_keys < 1:
        raise ValueError("index holds no key")
    manifest = spark.createDataFrame(
        [(v, n_keys, params.dim, params.k, Decimal(index_sum), Decimal(params_sum))], MANIFEST)
    manifest.coalesce(1).write.json(f"{base}/_manifest")
    return v


def pack_index(spark: SparkSession, root: str) -> int:
    """Copy the loose tables into the next bundle version (S5); returns the
    version. All three parts must exist and agree."""
    return _write_bundle(*_read_loose(spark, root), root)


def _newest(spark: SparkSession, root: str):
    """(folder, manifest) of the newest complete bundle, or None."""
    found = _manifests(spark, root)
    if not found:
        return None
    m = max(found, key=lambda r: r["version"])
    return f"{root}/bundle/v={m['version']}", m


def load_index(spark: SparkSession, root: str, checksums: bool = False):
    """(index, params): the newest complete bundle, else the loose tables (S6). The bundle's rows are
    counted (from the files' footers); ``checksums`` reads and adds up all of them as well."""
    if newest := _newest(spark, root):
        base, m = newest
        index, stored = (spark.read.parquet(f"{base}/{part}") for part in ("index", "params"))
        n = index.count()
        if n != m["n_keys"]:
            raise ValueError(f"{base}: the index has {n} keys, the manifest says {m['n_keys']}")
        if checksums and (_sums(index)[1], _sums(stored)[1]) != (m["index_sum"], m["params_sum"]):
            raise ValueError(f"{base}: rows differ from those that were packed")
        params = PcaParams.from_df(stored)
        if (params.dim, params.k) != (m["dim"], m["k"]):
            raise ValueError(f"{base}: params disagree with the manifest")
        return index, params
    index, params = _read_loose(spark, root)
    if index.limit(1).count() < 1:
        raise ValueError(f"index under {root} holds no key")
    return index, params


def pack_blocks(spark: SparkSession, root: str) -> None:
    """Write the block index of the newest bundle beside it."""
    base, m = _newest(spark, root) or (None, None)
    if base is None:
        raise FileNotFoundError(f"no bundle under {root}; pack the index first")
    index, _ = load_index(spark, root)
    built = mi.write_buckets(index, m["k"], f"{base}/blocks")
    n = built.sizes.agg(F.sum("n")).first()[0]
    spark.createDataFrame([(n,)], "n_rows long").coalesce(1).write.mode("overwrite").json(f"{base}/blocks/_manifest")


def load_blocks(spark: SparkSession, root: str) -> mi.Buckets | None:
    """The block index of the newest bundle; None where none was (wholly) written."""
    base, m = _newest(spark, root) or (None, None)
    if base is None:
        return None
    try:
        said = spark.read.schema("n_rows long").json(f"{base}/blocks/_manifest").first()["n_rows"]
    except AnalysisException as e:
        if _absent(e):
            return None
        raise
    found = mi.read_buckets(spark, m["k"], f"{base}/blocks")
    n = found.rows.count()
    if n != said:
        raise ValueError(f"{base}: {n} block rows, the manifest says {said}")
    return found


def rebuild(spark: SparkSession, index: DataFrame, params: PcaParams, root: str) -> int:
    """A new corpus snapshot: the next bundle version, complete once its manifest is
    there (C7). Earlier versions and the loose tables stay as they are, so ``index``
    may be read from ``root`` itself. There is no incremental update."""
    return _write_bundle(index, params, root)


__all__ = ["write_index", "pack_index", "load_index", "rebuild", "pack_blocks", "load_blocks"]
