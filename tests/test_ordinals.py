"""Dense ordinals, exact samples (R1) and the index's row numbers."""

import numpy as np
from pyspark.sql import functions as F

from bitdex.operators import index as ix
from bitdex.operators import ordinals as od
from bitdex.operators import pca as pc
from bitdex.sources import corpus as cs


def test_ordinals_do_not_change_with_the_splits(spark, sf001):
    def rows(parts):
        docs = cs.documents_corpus(spark, sf001, address=True).select("file", "position", "id").repartition(parts, "id")
        return sorted((r.row, r.id) for r in od.dense_ordinal(docs, ["file", "position"]).collect())
    got = rows(1)
    assert [r for r, _ in got] == list(range(len(got)))
    assert got == rows(50)
    assert [i for _, i in got] == [r.id for r in cs.documents_corpus(spark, sf001).select("id").collect()]


def test_order_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(3, "c"), (None, "n"), (1, "a"), (2, "b"), (2, "b")], "x int, y string").repartition(4)
    assert [(r.x, r.row) for r in od.dense_ordinal(df, ["x", "y"]).orderBy("row").collect()] == [
        (None, 0), (1, 1), (2, 2), (2, 3), (3, 4)]
    assert od.dense_ordinal(df.filter("x > 9"), ["x"]).collect() == []
    placed = od.numbered(df.orderBy(F.desc("x"), "y"), "place").collect()
    assert sorted((r.place, r.x) for r in placed) == [(0, 3), (1, 2), (2, 2), (3, 1), (4, None)]


def one_by_one(n, cap, seed):
    out, s = [], seed
    for _ in range(cap):
        s = (s * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append((s >> 33) % n)
    return out


def test_draws_enter_the_sequence_anywhere():
    want = one_by_one(977, 3000, od.DRAW_SEED)
    assert np.concatenate([od.draw_block(977, f, 500) for f in range(0, 3000, 500)]).tolist() == want
    assert od.draw_block(977, 2999, 1).tolist() == want[-1:]
    assert od.jump(7, 0) == 7


def test_sample_has_exactly_cap_rows(spark, monkeypatch):
    monkeypatch.setattr(od, "BLOCK", 64)
    want = sorted(one_by_one(5000, 1000, 1))
    for parts in (1, 30):
        rows = spark.range(5000).select(F.col("id").alias("row"), (F.col("id") * 2).alias("x")).repartition(parts)
        got = pc.fit_sample(rows, 1000, seed=1).collect()
        assert sorted(r.row for r in got) == want
        assert all(r.x == 2 * r.row for r in got)
    assert pc.fit_sample(rows, 5000).count() == 5000


def test_sample_in_a_given_order(spark):
    names = spark.createDataFrame([(f"n{i:03d}", i) for i in range(300)], "name string, row int").repartition(7)
    got = [r.row for r in pc.fit_sample(names, 100, ["name"]).collect()]
    assert sorted(got) == sorted(one_by_one(300, 100, od.DRAW_SEED))
    assert pc.fit_sample(names.drop("row"), 100).count() == 100


def test_index_rows_follow_corpus_order(spark):
    bodies = spark.createDataFrame([(f"id{i % 5}", "t", f"body {i}", "f", 99 - i) for i in range(40)],
                                   "id string, title string, body string, file string, position long")
    params = pc.PcaParams.identity(np.zeros(384), 64)

    def rows(df, parts):
        index, _ = ix.build_index(df.repartition(parts), params=params)
        return sorted(tuple(r) for r in index.collect())
    got = rows(bodies, 1)
    assert got == rows(bodies, 17)
    assert [(r[0], r[1], r[2]) for r in got] == [(n, n, f"id{(39 - n) % 5}") for n in range(40)]     # as addressed
    plain = rows(bodies.drop("file", "position"), 1)
    assert plain == rows(bodies.drop("file", "position"), 17)                                     # by id, title, key
    assert [r[2] for r in plain] == sorted(r[2] for r in plain)
