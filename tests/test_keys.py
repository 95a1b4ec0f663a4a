"""Sign packing, Hamming distance, bins (V6-V11, traps 4-6)."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitdex.functions import keys as kx
from bitdex.operators.pca import canonical_signs, pack_signs_np


def test_sign_pack_expression_matches_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=(20, 70))
    y[0, :] = 0.0
    y[1, 3] = np.nan
    rows = [([float(x) for x in r],) for r in y]
    df = spark.createDataFrame(rows, "y array<double>")
    got = np.array([list(r) for r in df.select(*kx.sign_pack(F.col("y"), 70)).collect()])
    want = pack_signs_np(np.nan_to_num(y, nan=0.0), 70)
    assert (got == want).all()
    assert (got[0] == 0).all()                   # zero vector -> zero key


def test_nan_gives_zero_bit(spark):
    df = spark.createDataFrame([([float("nan")] + [1.0] * 63,)], "y array<double>")
    w = df.select(*kx.sign_pack(F.col("y"), 64)).first()[0]
    assert w == (1 << 63) - 1


def test_key_hex_byte_order(spark):
    df = spark.createDataFrame([(-1, 0, 1 << 62, 1)], "w0 long, w1 long, w2 long, w3 long")
    h = df.select(kx.key_hex(["w0", "w1", "w2", "w3"])).first()[0]
    assert h == "f" * 16 + "0" * 16 + "4" + "0" * 15 + "0" * 15 + "1"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=12, max_size=12))
def test_hamming_properties(vals):
    a, b, c = (np.array(vals[i:i + 4], dtype=np.int64).view(np.uint64) for i in (0, 4, 8))
    d = lambda x, y: int(np.bitwise_count(x ^ y).sum())
    assert d(a, a) == 0 and d(a, b) == d(b, a)
    assert d(a, c) <= d(a, b) + d(b, c)


def test_hamming_expression(spark):
    df = spark.createDataFrame([(-1, 0, 5, 7)], "a long, b long, c long, d long")
    assert df.select(kx.hamming(["a", "c"], ["b", "d"])).first()[0] == 64 + 1


def test_bins_and_bands(spark):
    df = spark.createDataFrame([(d,) for d in [0, 7, 8, 59, 60, 76, 77, 82, 83, 255, 256]],
                               "d int")
    rows = df.select("d", kx.hist_bin("d", 256).alias("b"),
                     kx.confidence_band("d", 256).alias("band"),
                     kx.low_flag("d", 256).alias("low")).collect()
    assert [r.b for r in rows] == [0, 0, 1, 7, 7, 9, 9, 10, 10, 31, 32]
    assert [r.band for r in rows][3:9] == ["strong", "relevant", "relevant", "weak",
                                           "weak", "none"]
    assert [r.low for r in rows][7:9] == [False, True]
    hi = spark.range(33).select(kx.bin_high(F.col("id"), 256)).collect()
    assert hi[0][0] == 7 and hi[31][0] == 255 and hi[32][0] == 256


def test_canonical_signs_flip_keeps_distances():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(8, 16))
    cs = canonical_signs(c)
    idx = np.argmax(np.abs(cs), axis=1)
    assert (cs[np.arange(8), idx] > 0).all()
    x = rng.normal(size=(30, 16))
    k1, k2 = pack_signs_np(x @ c.T, 8), pack_signs_np(x @ cs.T, 8)
    d = lambda k: np.bitwise_count(k[:, None, 0].view(np.uint64) ^ k[None, :, 0].view(np.uint64))
    assert (d(k1) == d(k2)).all()
