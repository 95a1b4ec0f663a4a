"""Folding and basic tokens (F6, F7, G2, trap 13)."""

import unicodedata

from pyspark.sql import functions as F

from bitdex.functions import text as tx
from bitdex.operators.encode import py_fold, py_tokenize


def test_fold_table_rule():
    src, dst = tx.fold_table()
    table = dict(zip(src, dst))
    assert table["Z"] == "z" and table["ü"] == "u" and table["ć"] == "c"
    # not decomposable: left as-is
    for ch in "ßøłæĳ":
        assert ch not in table
    # the exceptions to the decomposition rule
    assert [table[c] for c in "ıĿŀſ"] == ["i", "l", "l", "s"]
    # combining marks are deleted (past the end of dst)
    assert src.index("́") >= len(dst)
    for cp in range(0xC0, 0x180):
        ch = chr(cp)
        if ch in table and ch not in tx.FOLD_EXCEPTIONS:
            assert unicodedata.normalize("NFD", ch)[0].lower() == table[ch]


def test_fold_and_tokens_spark_vs_python(spark):
    texts = ["Zürich – Marić “quoted” don’t",
             "cafés ok", "ß ø ł αβ 中文",
             "a,b.c!!", "  ", "TAB\tsep\x0bv\x1cx"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select(tx.fold_text("s"), tx.tokenize("s")).collect()
    for t, r in zip(texts, rows):
        assert r[0] == py_fold(t)
        assert list(r[1]) == py_tokenize(t)
    assert list(rows[0][1]) == ["zurich", "-", "maric", '"', "quoted", '"', "don", "'", "t"]
    assert list(rows[1][1]) == ["cafes", "ok"]
    assert list(rows[5][1]) == ["tab", "sep", "v\x1cx"]


def test_lower_is_ascii_only(spark):
    df = spark.createDataFrame([("ΑBCÆ",)], "s string")
    assert df.select(tx.fold_text("s")).first()[0] == "ΑbcÆ"
