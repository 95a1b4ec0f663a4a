"""Block index (J3, C5) against brute force, the scan and its own promises."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bitdex.functions import keys as kx
from bitdex.operators import multi_index as mi
from bitdex.operators import search as sr

RANGE = (-2**63, 2**63 - 1)


def _index(spark, keys, ords=None):
    ords = np.arange(len(keys), dtype=np.int64) if ords is None else ords
    pdf = pd.DataFrame({"row": np.arange(len(keys)), "ord": ords, "id": ords, "title": "t"})
    return spark.createDataFrame(pdf.assign(**{f"w{j}": keys[:, j] for j in range(keys.shape[1])})).repartition(3)


def _queries(spark, q):
    return spark.createDataFrame(pd.DataFrame({"qid": np.arange(len(q)), **{f"w{j}": q[:, j] for j in range(q.shape[1])}}))


def _flip(rng, key, bits, k):
    out = key.copy().view(np.uint64)
    for b in rng.choice(k, bits, replace=False):
        out[b // 64] ^= np.uint64(1 << (63 - int(b) % 64))
    return out.view(np.int64)


def _want(q, keys, ords, top):
    d = np.bitwise_count(q[:, None, :].view(np.uint64) ^ keys[None, :, :].view(np.uint64)).sum(-1)
    return [[(int(d[i, j]), int(ords[j]), int(j)) for j in np.lexsort((np.arange(len(keys)), ords, d[i]))[:top]]
            for i in range(len(q))]


def _got(hits, n):
    hits = hits.orderBy("qid", "rank").collect()
    return [[(r.dist, r.ord, r.row) for r in hits if r.qid == i] for i in range(n)]


def test_near_queries_are_settled_without_a_scan(spark, tmp_path):
    rng = np.random.default_rng(1)
    keys = rng.integers(*RANGE, size=(3000, 4), dtype=np.int64)
    keys[100:130] = keys[100]                                    # 30 equal keys
    for i in range(20):                                          # families of 8 near keys
        for j in range(8):
            keys[1000 + 8 * i + j] = _flip(rng, keys[1000 + 8 * i], 2 * j, 256)
    ords = rng.permutation(3000).astype(np.int64)
    q = np.concatenate([keys[[100]], keys[1000:1160:8], keys[[5]]])       # the last one has no near key
    index = _index(spark, keys, ords)
    buckets = mi.write_buckets(index, 256, str(tmp_path))
    hits, report = mi.knn_indexed(index, buckets, _queries(spark, q), 5)
    assert _got(hits, len(q)) == _want(q, keys, ords, 5)
    by_level = {r.level: r for r in report.collect()}
    assert by_level[-1].queries == 1                             # only the far one was scanned
    looked_up = sum(r.met for level, r in by_level.items() if level >= 0)
    assert looked_up < 0.2 * len(q) * len(keys)                  # a scan compares every key


@pytest.mark.parametrize("share, probes", [(0.0, 10), (2.0, 500), (100.0, 1_000_000)])
def test_any_routing_gives_the_same_answer(spark, tmp_path, share, probes):
    rng = np.random.default_rng(2)
    keys = rng.integers(*RANGE, size=(200, 1), dtype=np.int64) & np.int64(-1 << 24)       # 40 bits of 64
    keys[:90] = keys[0]
    ords = rng.integers(*RANGE, size=200, dtype=np.int64)
    q = np.concatenate([keys[:3], rng.integers(*RANGE, size=(4, 1), dtype=np.int64) & np.int64(-1 << 24)])
    index = _index(spark, keys, ords)
    buckets = mi.write_buckets(index, 40, str(tmp_path))
    hits, report = mi.knn_indexed(index, buckets, _queries(spark, q), 7, share=share, probes=probes)
    assert _got(hits, len(q)) == _want(q, keys, ords, 7)
    asked = {r.level: r.queries for r in report.collect()}
    assert asked[-1] == (7 if share == 0.0 else 0 if share == 100.0 else asked[-1])


def test_fewer_keys_than_asked_for_and_null_keys(spark, tmp_path):
    keys = np.array([[1], [2], [3]], np.int64)
    index = _index(spark, keys).withColumn("w0", F.when(F.col("row") != 2, F.col("w0")))
    buckets = mi.write_buckets(index, 64, str(tmp_path))
    for share in (0.25, 1000.0):
        hits, _ = mi.knn_indexed(index, buckets, _queries(spark, keys[:1]), 5, share=share)
        assert [(r.row, r.dist) for r in hits.orderBy("rank").collect()] == [(0, 0), (1, 2)]
    none = _queries(spark, keys[:0].reshape(0, 1)) if False else _queries(spark, keys[:1]).filter("qid < 0")
    assert mi.knn_indexed(index, buckets, none, 5)[0].collect() == []


def test_block_values(spark):
    df = spark.createDataFrame([(-2**63 + 5, 0x1234567890ABCDEF)], "w0 long, w1 long")
    got = df.select(*[c.alias(f"b{i}") for i, c in enumerate(mi.block_values(128))]).first()
    assert list(got) == [0x8000, 0, 0, 5, 0x1234, 0x5678, 0x90AB, 0xCDEF]
    assert mi.n_blocks(40) == 3 and kx.n_words(40) == 1
    assert [len(b) for b in mi.balls()[:4]] == [1, 16, 120, 560]


def test_stored_keys_meet_only_their_equals(spark, tmp_path):
    """All keys share three of four blocks: by blocks each query would meet every key."""
    keys = np.array([[(7 << 16) | (i % 100)] for i in range(300)], np.int64)
    ords = np.random.default_rng(3).permutation(300).astype(np.int64)
    index = _index(spark, keys, ords)
    buckets = mi.write_buckets(index, 64, str(tmp_path))
    for top in (1, 3):
        hits, report = mi.knn_indexed(index, buckets, _queries(spark, keys), top, share=1.0)
        assert _got(hits, 300) == _want(keys, keys, ords, top)
        assert [tuple(r) for r in report.filter("queries > 0").collect()] == [(mi.EQUAL, 300, 300 * top, 300)]
