import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bitdex.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, threshold=10, longest=3, top=2000, cover=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= threshold}
    dropped = set()
    for (lang, q), fq in cands.items():
        for m in range(2, len(q)):
            for i in range(len(q) - m + 1):
                if 100 * fq >= cover * f[lang, q[i:i + m]]:
                    dropped.add((lang, q[i:i + m]))
    out = {}
    for (lang, p), a in cands.items():
        if (lang, p) not in dropped:
            s, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), a, l, r, n[lang], -s) for lang, found in out.items()
                  for i, (s, _, p, a, l, r) in enumerate(sorted(found)[:top]))


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(x, t, "m", 1, "w") for x, t in rows], "lang string, text string, m string, n int, word string")
    return sorted(map(tuple, phrases.collocations(df.repartition(parts), **options).collect()))


def corpus(rnd, n, vocab=30):
    words = [f"w{i}" for i in range(vocab)] + ["É", "é", "Zz"]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for _ in range(n):
        w = rnd.choices(words, weights, k=rnd.randrange(1, 40))
        if rnd.random() < 0.3:
            w += ["New", "York", "City"]
        out.append((rnd.choice(["en", "de", None, "und", "fr"]),
                    "".join(x + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for x in w)))
    return out


def test_documents(spark, sf001):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("lang", "text").collect()]
    got = phrases.op11_collocations(spark, sf001)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(
        ["rank", "a", "l", "r", "n", "score"], "bigint")
    want = brute(rows)
    assert len(want) > 100
    assert sorted(map(tuple, got.collect())) == want


def test_hot_phrases_ties_and_edges(spark):
    rnd = random.Random(1)
    rows = corpus(rnd, 300) + [("en", "same text again and again")] * 150          # a third of all rows
    rows += [("en", None), ("en", ""), (None, None), ("xx", " \n "), ("yy", "alone"), ("en", "q " * 400), ("de", "no-break space " * 12)]
    want = brute(rows)
    assert {x[0] for x in want} >= {"en", "de", "fr", "und"}
    assert run(spark, rows) == want


@pytest.mark.parametrize("options", [{"threshold": 3, "longest": 4, "top": 7}, {"threshold": 5, "longest": 2, "cover": 90}])
def test_other_lengths_and_limits(spark, options):
    rows = corpus(random.Random(2), 150)
    assert run(spark, rows, shards=2, **options) == brute(rows, **options)


def test_a_full_filter_changes_no_result(spark):
    """64 slots: nearly every phrase is taken for a frequent one."""
    rows = corpus(random.Random(3), 120)
    assert run(spark, rows, slots=64) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [("en", None), ("en", "a b c")]) == []


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 50)
    rnd = random.Random(6)
    texts = ["".join(rnd.choices(["ab ", "c", " ", ". ", "\n", "wort "], k=rnd.randrange(200))) for _ in range(30)] + ["x y " * 90]
    found = Counter()
    for data, starts, row in phrases._runs(pa.array([t.encode() for t in texts], pa.binary())):
        low, first, length, part, on = phrases._words(data, starts)
        for i in np.flatnonzero(on):
            found[tuple(low[first[j]:first[j] + length[j]].tobytes() for j in (i, i + 1))] += 1
    want = Counter()
    for t in texts:
        for piece in re.split("[.,;:!?\x0A-\x0D]", t):
            w = piece.encode().split()
            want.update(zip(w, w[1:]))
    assert found == want


def test_scores_are_exact_past_64_bits(spark):
    a, l, r = 3 * 10**14 + 1, 7 * 10**14 + 3, 9 * 10**15 - 1
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert df.select(phrases._score("a", "l", "r")).first()[0] == 10**6 * a * a // (l * r)
