"""Bench: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Jobs (each forced with a ``noop`` write, so nothing is collected):
  startup       the same body selection and search on sf0.001: Python worker
                start-up and JIT warm-up, paid once per session (kept in the
                total, reported apart so the other entries are steady state)
  bodies        body selection for every document (lead / extraction), written
                once as the records table (as the reference pipes records into
                the index build)
  index_pca     records -> encode -> PCA fit on all rows -> keys, written once
  encode_bench  the keys of every benchmark item, encoded and written
  scan_300k     those keys against 300,000 keys, top 5 (the index tiled with its
                words changed); encoding, titles and URLs are not in it
  search_bench  top-5 for every benchmark item against the index, from the text
  search_conv   top-5 for every turn of conversations
  stats_bench   distance histogram for every benchmark item
  tokens        token profile of every whole document text
  wordpiece     word-piece profile of every document and turn
  covariance    64 x 64 covariance of the embeddings
  label_knn     64-bit keys of the embeddings table, top-5 per label centroid
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F            # noqa: E402

from bitdex.functions import keys as kx           # noqa: E402
from bitdex.operators import index as ix          # noqa: E402
from bitdex.operators import search as sr         # noqa: E402
from bitdex.plans import catalog as C             # noqa: E402
from bitdex.session import cut_lineage, local_session   # noqa: E402

SCAN_KEYS = 300_000


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def tiled(index, n: int):
    """At least ``n`` keys: each key again and again, with its words changed by a hash."""
    copies = -(-n // max(1, index.count()))
    words = kx.word_cols(C.K)
    many = index.select("row", *words).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return cut_lineage(many.select(
        (F.col("row") * copies + F.col("copy")).alias("ord"),
        *[F.col(w).bitwiseXOR(F.xxhash64("copy", "row", F.lit(w))).alias(w) for w in words]), "tiled")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        out = fn()
        times[name] = round(time.time() - t, 3)
        return out

    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(small) and small != sf_dir:
        timed("startup", lambda: (run(C.bodies(spark, small)), run(C.label_knn(spark, small))))
    bodies = timed("bodies", lambda: cut_lineage(C.bodies(spark, sf_dir), "records"))
    enc = C._encoder()
    index, params = timed("index_pca", lambda: ix.build_index(bodies, enc, C.K, projection="pca"))
    queries = C._bench_queries(spark, sf_dir)
    keys = timed("encode_bench", lambda: sr.number_queries(ix.encode_queries(queries, params, enc), C.K))
    many = tiled(index, SCAN_KEYS)
    timed("scan_300k", lambda: run(sr.knn(many, keys, C.K, C.TOP)))
    timed("search_bench", lambda: run(ix.search(queries, index, params, enc, C.TOP)))
    timed("search_conv", lambda: run(ix.search(C._conv_queries(spark, sf_dir), index, params, enc, C.TOP)))
    timed("stats_bench", lambda: run(ix.stats(queries, index, params, enc)))
    timed("tokens", lambda: run(C.token_profile(spark, sf_dir)))
    timed("wordpiece", lambda: run(C.wordpiece_profile(spark, sf_dir)))
    timed("covariance", lambda: run(C.covariance(spark, sf_dir)))
    timed("label_knn", lambda: run(C.label_knn(spark, sf_dir)))
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir).replace("sf", ""),
                      "cpus": cpus, "scan_keys": many.count(), "queries_scanned": keys.count()}))
    spark.stop()


if __name__ == "__main__":
    main()
