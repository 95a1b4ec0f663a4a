import hashlib

from pyspark.sql import functions as F

from bitdex.llm import merkle


def brute(rows):
    """(id, n, edited) in ascending order of id."""
    rows = sorted((i, t or "") for i, t in rows)
    out = []
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, k int, tree string")
    return merkle.edits(df).collect()


def test_documents(spark, sf001):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    got = merkle.op8_fingerprints(spark, sf001).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == brute(rows)
    texts = dict(rows)
    prints = {}
    for r in got:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(prints.values())) == len(prints)
    near = sum(r.near_edited > r.near_next for r in got)
    assert near > 0.9 * len(got)


def test_edges(spark):
    rows = [(5, "é😀x" * 50), (1, None), (9, ""), (7, "a. b. c."), (-3, "one\n\ntwo\n\n\nthree")]
    got = run(spark, rows)
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == brute(rows)
    assert run(spark, [(4, "alone again")])[0].near_next == 1.0
    assert run(spark, []) == []
    long = [(i, "word, " * 30000 + str(i)) for i in range(3)]
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in run(spark, long)) == brute(long)


def test_null_shared_and_repeated_rows(spark):
    rows = [(None, "n"), (None, "m"), (2, "same row"), (2, "same row"), (2, "other"), (3, "last")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    same = [r for r in got if r.n_chars == 8]
    assert len(same) == 2 and same[0] == same[1]


def test_tree_locates_edits(spark):
    a = "Head one.\nsame, line.\n\nsecond part.\nit ends."
    b = "Head one.\nsame, line!\n\nsecond part.\nit ends. More."
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        *[merkle.fingerprint(merkle.tree(F.col(c))).alias(c) for c in "ab"])
    row = row.select("*", merkle.changed(F.col("a"), F.col("b")).alias("d"), merkle.changed(F.col("a"), F.col("a")).alias("n"))
    r = row.first()
    assert [(x.section, x.paragraph) for x in r.d] == [(0, 1), (1, 1)] and r.n == []
    lossless = spark.createDataFrame([("x\n\n y\n\n\n\nz\n",)], "t string").select(
        F.split("t", merkle.SECTION).alias("s"), F.split("t", merkle.PARAGRAPH).alias("p"),
        F.regexp_extract_all("t", F.lit(merkle.PIECE), F.lit(0)).alias("q")).first()
    assert "".join(lossless.s) == "".join(lossless.p) == "".join(lossless.q) == "x\n\n y\n\n\n\nz\n"
