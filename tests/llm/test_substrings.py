import hashlib
import re
from collections import Counter

from bitdex.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    """Removed flags by counting every window of every text."""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if seen[tuple(w[s:s + k])] > 1:
                gone[s:s + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, k, m):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.cut_repeats(df, k=k, m=m)
    return sorted(((r["doc_id"], r["_n_words"], r["_n_removed"], r["_sha"]) for r in got.collect()),
                  key=str)


def test_documents_against_all_windows(spark, sf001):
    got = substrings.op3_substring_dedup(spark, sf001)
    rows = [(r.doc_id, r.text) for r in
            spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()),
                  key=str) == brute(rows, 35)


def test_planted_overlaps_ties_and_edges(spark):
    import random
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["é", "z"]
    base = [[rnd.choice(vocab) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(120):
        a, b = rnd.choice(base), rnd.choice(base)
        x, y = rnd.randrange(60), rnd.randrange(60)
        mid = [rnd.choice(vocab) for _ in range(rnd.randrange(8))]
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(a[x:x + rnd.randrange(30)] + mid + b[y:])))
    rows += [(500, None), (501, ""), (502, " \n"), (None, "a b c d e f g h i j k l"),
             (None, "a b c d e f g h i j k l"), (503, "q " * 40), (504, "no-break space x"),
             (505, "same row twice " * 5), (505, "same row twice " * 5)]
    assert run(spark, rows, 9, 4) == brute(rows, 9)
    assert run(spark, rows, 12, 3) == brute(rows, 12)


def test_long_text_empty_table_and_extra_columns(spark):
    long = " ".join(str(i % 5000) for i in range(60000))
    assert run(spark, [(1, long), (2, "x y z")], 35, 8) == brute([(1, long), (2, "x y z")], 35)
    assert run(spark, [], 35, 8) == []
    df = spark.createDataFrame([(1, "a b c", "k", 5)], "doc_id long, text string, rk string, mini int")
    row = substrings.cut_repeats(df, k=2, m=1).collect()[0]
    assert (row["rk"], row["mini"], row["text"]) == ("k", 5, "a b c")
