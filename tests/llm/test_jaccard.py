import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from bitdex.llm import jaccard
from bitdex.llm.components import components
from bitdex.session import ensure_checkpoint_dir


def sets(rows):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute(rows):
    found = sets(rows)
    up = list(range(len(found)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    holders = defaultdict(list)
    for k, (_, s) in enumerate(found):
        for g in s:
            holders[g].append(k)
    for k, (_, s) in enumerate(found):
        common = Counter(j for g in s for j in holders[g] if j > k)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(found[j][1]) - n):
                up[max(top(k), top(j))] = min(top(k), top(j))
    least = {}
    for k, (i, s) in enumerate(found):
        least.setdefault(top(k), []).append(i)
    return sorted((i, len(s), min(least[top(k)]) if s else i) for k, (i, s) in enumerate(found))


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sid string, n int")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, **options).collect())


def family(rnd, size, length, edits, start):
    base = [f"v{rnd.randrange(10**6)}" for _ in range(length)]
    out = []
    for i in range(size):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(length)] = f"e{rnd.randrange(10**6)}"
        out.append((start + i, " ".join(w)))
    return out


def test_large_region_with_pivots_and_windows(spark):
    rnd = random.Random(2)
    rows = family(rnd, 150, 120, 9, 0) + family(rnd, 40, 60, 4, 1000)
    shared = " ".join(f"s{i}" for i in range(30))
    rows += [(2000 + i, shared + " " + " ".join(f"u{i}x{j}" for j in range(rnd.randrange(8, 60)))) for i in range(80)]
    rows += [(3000 + i, " ".join(rows[i][1].split()[:110])) for i in range(40)]
    want = brute(rows)
    assert run(spark, rows, region=16, block=8, pivots=3, outer=5) == want
    assert run(spark, rows) == want


def test_planted_edges(spark):
    rows = [(9, "a b"), (4, "A  b"), (5, "b a"), (6, None), (7, ""), (8, "\n"), (1, "same row x"), (1, "same row x"),
            (20, "É b c d e f"), (21, "é b c d e f"), (30, "q " * 50), (31, "Q " * 9), (40, "long " * 5 + "word " * 30000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    got = jaccard.near_duplicates(spark.createDataFrame([(None, "a b"), (3, "a b"), (None, "")], "doc_id long, text string"))
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in got.collect()))) == ["(3, 3)", "(None, 3)", "(None, None)"]


def test_documents(spark, sf001):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    got = jaccard.op9_jaccard_join(spark, sf001).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_overlaps_and_threshold():
    rnd = np.random.default_rng(0)
    a = [np.unique(rnd.integers(0, 90, rnd.integers(0, 40)).astype(np.uint64)) for _ in range(9)]
    b = [np.unique(rnd.integers(0, 90, rnd.integers(0, 40)).astype(np.uint64)) for _ in range(5)]
    assert (jaccard.overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
    whole = [[len(np.intersect1d(x, y)) for y in a] for x in a]
    assert (np.triu(jaccard.overlaps(a), 1) == np.triu(whole, 1)).all()
    like, linked = jaccard.jaccards(np.array([[3.0, 2.0]]), np.array([4]), np.array([3, 3]))
    assert linked.tolist() == [[True, False]] and like[0, 0] == 0.75


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        up[top(a)] = top(b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(up)
    assert len({(got[x], top(x)) for x in up}) == len({top(x) for x in up}) == len(set(got.values()))


def test_small_sets_link_wherever_their_own_shingle_falls(spark):
    """7- and 8-word texts with 3 common shingles of 4, the odd one at any place of the hash order."""
    rnd = random.Random(5)
    rows = []
    for i in range(200):
        w = [f"p{rnd.randrange(10**6)}" for _ in range(8)]
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w[1:] if i % 2 else w[:-1]))]
    want = brute(rows)
    assert all(least == i - i % 10 for i, _, least in want)
    assert run(spark, rows) == want


def test_least_credit_is_the_worst_case():
    """Against every pair of linked sizes with the odd hashes first, counted rank by rank."""
    for share in (0.4, 0.1, 1.0):
        for a in range(1, 60):
            least = []
            for b in range(1, 90):
                for common in range(1, min(a, b) + 1):
                    if 100 * common >= 75 * (a + b - common):
                        seen = [max(0, int(jaccard.scanned(np.int64(n), share)) - (n - common)) for n in (a, b)]
                        least.append(min(*seen, common))
            assert jaccard.least_credit(a, share) == min(least) >= 1


def test_hashes_travel_by_half(monkeypatch):
    """Four bytes a hash; of hashes that agree in those, no set loses its credit."""
    parts = 4
    a = [(5 << 32) | (x << 8) | 1 for x in range(3)] + [(7 << 32) | 2, (9 << 32) | 3]       # three agree
    b = [(5 << 32) | 1, (8 << 32) | 2, (9 << 32) | 3]
    def credits(slices):
        monkeypatch.setattr(jaccard, "_slices", lambda *_: iter(slices))
        rows = pa.Table.from_batches(list(jaccard._scatter(5, parts, 1.0)([])))
        sent = [r for r in rows.to_pylist() if r["part"] >= 0]
        assert all(len(r["hashes"]) == 4 * np.frombuffer(r["ns"], np.int32).sum() for r in sent)
        got = Counter()
        for batch in jaccard._credit(iter(rows.to_batches())):
            for sid, n in zip(*(c.to_pylist() for c in batch.columns)):
                got[sid] += n
        return got
    a, b = (np.array(sorted(x), np.uint64) for x in (a, b))
    one, two = credits([{11: a, 12: b}]), credits([{11: a}, {12: b}])
    for got in (one, two):                          # both have two hashes in common
        assert got[11] >= 2 and got[12] >= 2
    assert one[11] == two[11] == 4 and credits([{12: b}, {12: b}])[12] == 0


def test_outer_sets_go_only_where_a_rare_hash_is(spark):
    cells = spark.createDataFrame([(1, 5, 50, 0.1, 100), (1, 5, 51, 0.2, 101), (1, 6, 60, 0.0, 102), (1, 6, 61, 0.9, 103)],
                                  "region long, cell long, block long, dist double, sid long")
    outer = spark.createDataFrame([(1, 103), (1, 101)], "region long, sid long")
    far = spark.createDataFrame([(1, 103, 5, 0.3), (1, 103, 6, 0.9), (1, 101, 5, 0.2)],
                                "region long, sid long, cell long, d double")
    heads = spark.createDataFrame([(100, 1), (103, 1), (102, 2), (103, 2), (101, 3), (102, 3)], "sid long, h long")
    got = sorted(tuple(r) for r in jaccard._copies(outer, cells, far, heads).collect())
    # block 51 has no hash of 103; block 60 is too far from 103; 101 has no distance to cell 6
    assert got == [(1, 50, 103), (1, 51, 101), (1, 60, 101), (1, 61, 103)]


def test_tables_of_steps_go(spark):
    """Only what the result is read from stays, and a row that comes many times is packed and joined as one."""
    base = ensure_checkpoint_dir(spark)
    top = os.path.join(base, f"bitdex-{spark.sparkContext.applicationId}").removeprefix("file:")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    w = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(w[:58 + i])) for i in range(3)] + [(1, " ".join(w[:59]))] * 40 + [(9, "other words " * 4)]
    assert run(spark, rows, region=2, block=2, pivots=1, outer=1) == brute(rows)
    left = {x.rpartition("-")[0] for x in set(os.listdir(top)) - before}
    assert {"sets", "classes"} <= left and not left & {"chosen", "packs", "heads", "least", "marks", "cells", "distances"}
