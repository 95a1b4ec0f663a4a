import math
import random

import numpy as np
from pyspark.sql import functions as F

from bitdex.llm import topk

END = (1 << 63) - 1


def brute(rows, top, every=50):
    """Exact products of all pairs with Python integers."""
    whole = [(i, n, [min(max(math.floor(256 * x), -END - 1), END) for x in v]) for n, (i, v) in enumerate(rows)
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, q in whole:
        if i is None or i % every:
            continue
        found = [(min(max(sum(a * b for a, b in zip(q, v)), -END - 1), END), j, m) for j, m, v in whole if m != n]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
        out += [(i, r + 1, j, s) for r, (s, j, _) in enumerate(found[:top])]
    return sorted(out, key=str)


def run(spark, rows, top=5, **options):
    # one partition, so that the order of the rows is the order of the list
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows],
                               "vec_id long, embedding array<double>, row string, v int, q int").coalesce(1)
    got = topk.top_products(df, F.col("vec_id") % 50 == 0, top, **options).collect()
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got), key=str)


def test_embeddings(spark, sf001):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf001}/embeddings.parquet").collect()]
    got = topk.op12_topk(spark, sf001)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 5)


def test_nulls_ties_repeats_and_unlike_lengths(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5]) for _ in range(4)]) for i in range(130)]     # many ties
    rows += [(50, [0.5, 0.5, 0.5, 0.5]), (50, [0.5, 0.5, 0.5, 0.5]), (None, [0.5] * 4), (None, [0.5] * 4),
             (150, None), (200, [0.1, None]), (250, [float("nan")] * 4), (300, [float("inf"), 1.0]),
             (350, []), (400, [2.0]), (450, [0.25] * 9), (-50, [-0.3, 0.2, 0.0, 0.1])]
    want = brute(rows, 5)
    assert run(spark, rows) == want
    assert run(spark, rows, block=3, pivots=2, seed=1, query_bytes=100) == want      # several groups
    assert run(spark, rows, top=500, block=7) == brute(rows, 500)


def test_scores_past_64_bits_end_at_the_range(spark):
    rows = [(0, [1e16, -1e16]), (1, [1e16, -1e16]), (2, [-1e16, 1e16]), (50, [1e300, 0.0]), (3, [-1e300, 1e300])]
    assert run(spark, rows) == brute(rows, 5)


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_blocks_below_the_kth_score_are_not_scored(monkeypatch):
    """On vectors in well-separated groups most blocks are left out, and nothing is lost."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 200
    v = np.floor(np.repeat(centres, 32, axis=0) + rng.normal(size=(1280, 16)) * 4).astype(np.int64)
    rows = np.arange(len(v))
    cuts = [slice(i, i + 32) for i in range(0, len(v), 32)]
    lo, hi = (np.array([f(v[c], axis=0) for c in cuts]) for f in (np.min, np.max))
    blocks = topk.pa.RecordBatch.from_arrays(
        [topk.pa.array(range(len(cuts))), *(topk._lists(list(x)) for x in (lo, hi)),
         topk._lists([v[c].ravel() for c in cuts]), *(topk._lists([rows[c] for c in cuts]) for _ in range(2))],
        names=["block", "lo", "hi", "forward", "ids", "rows"])
    scored = []
    score = topk.Best.score
    monkeypatch.setattr(topk.Best, "score", lambda self, q, *block: (scored.append(len(q)), score(self, q, *block)))
    q = np.arange(0, len(v), 50)

    class Shared:
        value = (q, v[q], np.full(len(q), -END - 1))
    (found,) = topk._search(Shared, 5)(iter([blocks]))
    assert sum(scored) < 0.25 * len(q) * len(cuts)
    got = {}
    for a, s, b in zip(*(found.column(i).to_pylist() for i in range(3))):
        got.setdefault(a, []).append((-s, b))
    for a in q:
        want = sorted((-int(v[a] @ v[b]), b) for b in rows if b != a)[:5]
        assert sorted(got[a])[:5] == want


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, v = rng.integers(-99, 99, (30, 7)), rng.integers(-99, 99, (50, 9))
    b = topk.bounds(q, v.min(axis=0)[None], v.max(axis=0)[None])
    assert (b[:, 0] >= topk.dots(q, v).max(axis=1)).all()
    assert (topk.dots(q, v) == q @ v[:, :7].T).all()
