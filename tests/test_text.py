"""Body-selection string rules (P1-P11, traps 1, 2, 12, 20): literal inputs and results."""

import pytest
from pyspark.sql import functions as F

from bitdex.functions import text as tx

# the 29 code points Python's str.isspace accepts
WS_POINTS = [c for c in range(0x110000) if chr(c).isspace()]


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "s string").select(col(F.col("s"))).first()[0]


def test_ws_class_is_python_whitespace(spark):
    assert len(WS_POINTS) == 29
    rows = [(chr(c),) for c in WS_POINTS] + [("a",), ("​",), ("_",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(F.regexp_like("s", F.lit("^" + tx.WS + "$"))).collect()]
    assert got == [True] * 29 + [False, False, False]


@pytest.mark.parametrize("s,want", [
    ("  a \t b　c ", "a b c"), ("\x1c x \x85y ", "x y"), ("", ""), ("   ", ""), ("a  b", "a b"),
    ("x  y ", "x y"), ("no​break", "no​break"),
])
def test_normalize(spark, s, want):
    assert one(spark, tx.normalize_ws, s) == want


@pytest.mark.parametrize("body,cap,want", [
    ("Short one.", 20, "Short one."), ("Exactly ten", 11, "Exactly ten"),
    ("No sentence end here at all", 10, "No sentenc"), ("A b. C d! E f? G h", 14, "A b. C d!"),
    ("Ends at the last. ", 18, "Ends at the last. "), ("Ends at the last. x", 18, "Ends at the last."),
    ("e.g. abbrev. x y z w", 12, "e.g."), ("One.　Two. three", 10, "One.　Two."), ("One.　Two. three", 9, "One."),
    ("cut at a blank  here", 15, "cut at a blank "),
])
def test_sentence_cap(spark, body, cap, want):
    df = spark.createDataFrame([(body,)], "s string")
    assert df.select(tx.sentence_cap("s", cap)).first()[0] == want


@pytest.mark.parametrize("text,want", [
    ("P one.\n\nP two.\n \t\nP three.\n\nP four.", ["P one.", "P two.", "P three.", "P four."]),
    ("A.\n\nB b.\n\nC c. D d. E e. F f.", ["A.", "B b.", "C c.", "D d.", "E e.", "F f."]),
    ("x\n\nlonger para\n\n  \n\nother one\n\nlast one\n\nq\n\nmore  text", ["longer para", "other one", "last one", "more text"]),
    ("x\n\nlonger para\n\nother one\n\nq", ["x longer para other one q"]),
    ("One sentence only", ["One sentence only"]), ("Why? Yes! No. a", ["Why?", "Yes!", "No."]),
])
def test_split_units(spark, text, want):
    assert one(spark, tx.split_units, text) == want


def test_titles(spark):
    rows = [(None,), ("",), ("   ",), ("a\tb",), ("a\nb",), ("a\rb",), (" T ",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(tx.clean_title("t"), tx.title_query("t"), tx.first_line_title("t")).collect()
    assert [g[0] for g in got] == ["", "", "   ", "a b", "a b", "a\rb", " T "]
    assert [g[1] for g in got] == ["article", "article", "article", "a\tb", "a\nb", "a\rb", "T"]
    assert [g[2] for g in got] == [None, "", "   ", "a\tb", "a", "a\rb", " T "]
    long = "w " * 300
    assert one(spark, tx.first_line_title, long + "\nnext") == long       # the whole line


def test_lead_properties_of_documents(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    for r in docs.select("text", tx.lead("text").alias("lead")).collect():
        whole = " ".join(r.text.split())
        assert whole.startswith(r.lead) and len(r.lead) <= 1200
        assert r.lead == whole if len(whole) <= 1200 else r.lead[-1] in ".!?" or len(r.lead) == 1200
