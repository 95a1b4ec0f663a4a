"""Encoder protocol (C2, U1, U2, A5, V2, trap 16)."""

import numpy as np
from pyspark.sql import functions as F

from bitdex.operators import encode as enc
from bitdex.functions import vectors as vx


def test_jvm_and_arrow_paths_agree(spark):
    texts = ["Hello, world!", "Zürich café", "", None, "   ", "a a a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    e = enc.HashPoolEncoder(dim=128)
    rows = df.select(enc.encode_col("t", e, "jvm").alias("a"),
                     enc.encode_col("t", e, "python").alias("b")).collect()
    for r, t in zip(rows, texts):
        a, b = np.array(r.a), np.array(r.b)
        assert (a == b).all()
        if t and t.strip():
            assert abs(np.linalg.norm(a) - 1) < 1e-12
        else:
            assert not a.any()                         # zero vector for no tokens


def test_scores_udf_matches_dot(spark):
    e = enc.HashPoolEncoder(dim=128)
    df = spark.createDataFrame([("title words", ["title words here", "other text", "x"])],
                               "t string, u array<string>")
    got = df.select(enc.score_col("t", "u", e)).first()[0]
    m = e.encode_batch(["title words", "title words here", "other text", "x"])
    assert np.allclose(got, m[1:] @ m[0])


def test_mean_pool_table_form(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0])],
                               "id long, v array<double>")
    got = {r.id: list(r.vec) for r in enc.mean_pool(df, "id", "v").collect()}
    assert np.allclose(got[1], [0.6, 0.8]) and got[2] == [0.0, 0.0]


def test_l2_normalize_and_dot(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vx.l2_normalize("a").alias("n"), vx.cosine("a", "b").alias("c"),
                  vx.has_dim("a", 2).alias("ok"), vx.has_dim("a", 3).alias("bad")).first()
    assert np.allclose(r.n, [0.6, 0.8]) and abs(r.c - 0.6) < 1e-12 and r.ok and not r.bad


def test_memory_does_not_follow_the_batch():
    """10,000 texts of 220 tokens in one call stay within 500 MB."""
    import subprocess
    import sys
    code = ("import resource, sys; sys.path.insert(0, %r)\n"
            "from bitdex.operators.encode import HashPoolEncoder\n"
            "texts = [' '.join('t%%d' %% ((i * 7 + j * 13) %% 5000) for j in range(220)) for i in range(10000)]\n"
            "e = HashPoolEncoder(); e.sums_batch(texts[:10])\n"
            "a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; e.sums_batch(texts)\n"
            "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) / 1024)")
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code % root], capture_output=True, text=True, check=True).stdout
    assert float(out) < 500


def test_long_texts_are_read_whole():
    e = enc.HashPoolEncoder(dim=128)
    a, b = "x y " * 40_000, "z " * 100
    whole = e.sums_batch([a, b, a + b])
    assert (whole[2] == whole[0] + whole[1]).all() and whole[0].any()
    few = enc.HashPoolEncoder(dim=128, max_tokens=3)
    assert (few.sums_batch(["a b c d"]) == few.sums_batch(["a b c"])).all()


def test_encoder_source_is_loaded_once_in_a_worker(spark):
    def load():
        class Made:
            dim = 2

            def encode_batch(self, texts):
                from bitdex.operators import encode as e
                return np.array([[len(e._LOADED), id(self) % 1000] for _ in texts], dtype=float).reshape(len(texts), 2)
        return Made()

    source = enc.EncoderSource("made here", load, 2)
    df = spark.range(64).repartition(8).select(F.col("id").cast("string").alias("t"))
    got = {tuple(r.v) for r in df.select(enc.encode_col("t", source).alias("v")).collect()}
    assert {x[0] for x in got} == {1.0}                       # one entry, however many tasks
    plain = load()
    assert enc.loaded(plain) is plain


def test_batches_of_like_texts():
    rng = np.random.default_rng(0)
    tokens = np.sort(rng.integers(0, 600, 4000))
    cuts = enc.even_batches(tokens, 4096)
    assert [i for c in cuts for i in range(c.start, c.stop)] == list(range(4000))
    for c in cuts:
        part = tokens[c]
        assert part[-1] <= max(1, part[0]) * 1.1
        assert len(part) == 1 or part[-1] * len(part) <= 4096
    padded = sum(int(tokens[c][-1]) * (c.stop - c.start) for c in cuts)
    assert padded < 1.1 * tokens.sum()
    assert enc.even_batches(tokens[:0]) == [] and enc.even_batches(np.array([10**6])) == [slice(0, 1)]


def test_even_embedding_equals_embed(spark):
    rows = [(i, "word " * (i * 7 % 90), "x") for i in range(300)] + [(900, None, "y"), (901, "", "z"), (901, "", "z")]
    df = spark.createDataFrame(rows, "id long, text string, other string").repartition(3)
    e = enc.HashPoolEncoder(dim=128)
    got = sorted((r.id, r.other, tuple(r.vec)) for r in enc.embed_even(df, "text", "vec", e, batch_tokens=200).collect())
    want = sorted((r.id, r.other, tuple(r.vec)) for r in enc.embed(df.fillna("", ["text"]), "text", "vec", e, "python").collect())
    assert got == want


def test_workers_encode_a_bounded_number_of_rows_at_a_time(spark):
    from bitdex.operators import pca as pc

    class Narrow:
        dim = 2

        def encode_batch(self, texts):
            if len(texts) > 2000:
                raise ValueError(f"{len(texts)} rows at once")
            return np.array([[len(t), -1.0] for t in texts]).reshape(len(texts), 2)

    df = spark.range(5000).coalesce(1).select("id", F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("t"))
    got = enc.embed(df, "t", "v", Narrow()).collect()
    assert all(list(r.v) == [r.id % 9, -1.0] for r in got) and len(got) == 5000
    keys = pc.encode_project_keys(df, "t", Narrow(), pc.PcaParams.identity(np.array([4.0, 0.0]), 2), ["id"])
    assert all(r.w0 == (-2**63 if r.id % 9 > 4 else 0) for r in keys.collect())


def test_bits_are_counted_past_a_byte_and_past_the_table(monkeypatch):
    bits = np.random.default_rng(0).integers(0, 2, (3000, 128)).astype(np.uint8)
    bits[:700] = 1
    starts = np.array([0, 700, 701, 2999])
    assert (enc.count_bits(bits, starts) == np.add.reduceat(bits.astype(int), starts, axis=0)).all()
    e, texts = enc.HashPoolEncoder(dim=128), [" ".join(f"w{i * j % 977}" for j in range(300)) for i in range(40)]
    want = e.sums_batch(texts)
    monkeypatch.setattr(enc, "TABLE_CHARS", 100)
    assert (e.sums_batch(texts) == want).all()
