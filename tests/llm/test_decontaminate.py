import random
import re
from collections import Counter

from pyspark.sql import functions as F

from bitdex.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string, size int, rk string", "item_id long, text string, w_sim int"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingles(w):
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            b = words(x)
            best = 0.0
            for s in range(len(w)) if b else ():
                a, c = shingles(w[s:s + len(b)]), shingles(b)
                common = sum((a & c).values())
                best = max(best, common / (sum(a.values()) + sum(c.values()) - common))
            if best >= 0.75:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    return {(r.doc_id, r.item_id): r.similarity for r in dc.leaks(d, b).collect()}, d, b


def test_edited_passages(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]           # noqa: E731
    items = [(i, " ".join(text(rnd.choice([20, 30, 60])))) for i in range(12)]
    items += [(50, "two words"), (51, None), (52, " !"), (53, items[0][1]), (54, "a " * 30)]
    docs = []
    for n in range(60):
        passage = items[n % 12][1].split()
        for _ in range(n % 4):                                        # replace some words
            passage[rnd.randrange(len(passage))] = "edited"
        docs.append((n, " ".join(text(rnd.randrange(80)) + passage + text(rnd.randrange(80))).title()))
    docs += [(100, None), (101, ""), (102, "Two, words!"), (103, "a " * 200), (None, items[3][1]), (None, items[4][1]),
             (104, items[5][1]), (104, items[5][1])]
    got, d, b = found(spark, docs, items)
    want = brute(docs, items)
    assert {k for k, v in want.items() if v > 0.8} <= set(got) <= set(want)
    assert len(got) >= 0.97 * len(want)
    assert all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    kept = dc.clean(d, b)
    assert kept.columns == d.columns
    bad = {k[0] for k in got} - {None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, _ in docs if i is not None} - bad
    for x, y in ((d.limit(0), b), (d, b.limit(0))):
        assert dc.leaks(x, y).collect() == []


def test_hamming_blocks_find_every_pair_within_the_radius(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) - (1 << 63) for _ in range(30)]
    flip = lambda x, n: x ^ sum(1 << b for b in rnd.sample(range(63), n))          # noqa: E731
    wins = [(i, 9, flip(base[i % 30], rnd.randrange(33))) for i in range(600)]
    w = spark.createDataFrame(wins, "n int, size int, w_sim long")
    i = spark.createDataFrame([(k, 9, x) for k, x in enumerate(base)], "item_id int, size int, i_sim long")
    got = [(r.n, r.item_id) for r in dc.hamming_join(w, i).collect()]
    mask = (1 << 64) - 1
    want = {(n, k) for n, _, x in wins for k, y in enumerate(base) if ((x ^ y) & mask).bit_count() <= dc.RADIUS}
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_weighs_by_count(spark):
    row = spark.range(1).select(dc.simhash(F.array(*[F.lit(x).cast("bigint") for x in (5, 5, 2)])).alias("s")).first()
    assert row.s == 5


def test_documents_table(spark, sf001):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    grams = {g for _, t in items for g in shingles(words(t))}
    near = [(i, t) for i, t in docs if grams & set(shingles(words(t)))]
    got = {(r.doc_id, r.item_id) for r in dc.op7_decontamination(spark, sf001).collect()}
    assert got == set(brute(near, items))
