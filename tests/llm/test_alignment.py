import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bitdex.llm import alignment

DIR = "/opt/tokenizers"


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(f"{DIR}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{DIR}/piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tok():
    return alignment.Tokenizers(*(open(f"{DIR}/{f}", "rb").read() for f in (alignment.A_FILE, alignment.B_FILE)))


LETTERS = {c: bytes([b]) for c, b in zip(
    [chr(b) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b else None for b in range(256)], range(256)) if c}
LETTERS |= {chr(256 + i): bytes([b]) for i, b in enumerate(b for b in range(256) if chr(b) not in LETTERS)}


def whole(both, text):
    """Groups of a whole text, from encoding it at once."""
    a, b = both
    if not text:
        return []
    x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    xs = [b"".join(LETTERS[c] for c in t) for t in x.tokens]
    ys = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
          for i, p in ((i, b.id_to_piece(i)) for i in y)]
    if b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
        return []
    ends = [np.cumsum([len(t) for t in ts]).tolist() for ts in (xs, ys)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in cuts]
    for side, (ids, e) in enumerate(((x.ids, ends[0]), (y, ends[1]))):
        for i, end in zip(ids, e):
            groups[int(np.searchsorted(cuts, end))][side].append(i)
    return groups


def brute(both, rows):
    found = [whole(both, t) for _, t in rows]
    links = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for g in found]
    held = Counter(p for one in links for p in one)
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for (i, _), g, one in zip(rows, found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(one.values()),
                    sum(n for p, n in one.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in one.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1, "r") for i, t in rows],
                               "doc_id long, text string, id string, pack int, row string")
    return sorted((tuple(r) for r in alignment.align(df, **options).select(*COLUMNS).collect()), key=str)


HARD = ["", None, " ", "  ", "a", " a ", "a  b   c", "x\n y", "x \n \n y\t z", "tabs\tand\r\nlines\n\n\nhere ",
        "naïve café — “quotes” …", "Привет мир, как дела", "日本語 の テキスト です", "no break   space 　 wide",
        "emoji 👍🏽 family 👨‍👩‍👧 ok", "mark ▁ literal", "▁", "<s> </s> <unk> <0x41> <|endoftext|> end", "don't I'll we've",
        "nul \x00 here", "é combining ́ alone", "1234567890 3.14 2,000", "A" * 700, "ab" * 300 + " " + "=" * 200,
        "\u0085 next   line   par", "ſt ﬁ ① ½ Å", "same row", "same row"]


def test_documents(spark, sf001, both):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()]
    got = alignment.op13_alignment(spark, sf001)
    assert got.columns == COLUMNS
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(both, rows)


def test_hard_texts_in_packs_and_in_ranges(spark, both):
    rnd = random.Random(4)
    words = [w for t in HARD if t for w in t.split(" ")] + list("aé日 \n\t.") + [" ", "ß", "zzz"]
    rows = list(enumerate(HARD)) + [(100 + i, rnd.choice([" ", "", "  "]).join(rnd.choices(words, k=60))) for i in range(60)]
    rows += [(None, "null id"), (7, "id again"), (8, "id again")]
    want = brute(both, rows)
    assert run(spark, rows) == want
    for chunk in (5, 64):                     # cut anywhere, composed in several rounds
        assert run(spark, rows, chunk=chunk) == want


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def tokens(tok, text):
    return alignment.encoded(b" " + text.encode(), tok)


def test_compose_is_associative_and_equals_the_whole(tok, both):
    rnd = random.Random(2)
    text = "".join(rnd.choices(["the ", "unbelievable ", "Straße", "naïveté ", "zz", "\n", "1234 ", "…"], k=120))
    t = tokens(tok, text)
    for _ in range(30):
        at = sorted(rnd.sample(range(1, int(t.a_end[-1])), 9))
        parts = []
        for i, (lo, hi) in enumerate(zip([0, *at], [*at, int(t.a_end[-1])])):
            a = slice(*np.searchsorted(t.a_end, [lo, hi], "right"))
            b = slice(*np.searchsorted(t.b_end, [lo, hi], "right"))
            f, g = alignment.fragment(alignment.Tokens(t.a[a], t.a_end[a], t.b[b], t.b_end[b]), i, tok)
            parts.append((f, len(g.n_a)))

        def fold(parts):
            """Any tree: (fragment, closed groups, joints)."""
            if len(parts) == 1:
                return parts[0][0], parts[0][1], []
            m = rnd.randrange(1, len(parts))
            x, n, j = fold(parts[:m])
            y, k, l = fold(parts[m:])
            f, group = alignment.compose(x, y)
            return f, n + k, j + l + ([group] if group else [])
        trees = [fold(parts) for _ in range(5)]
        assert all(x[0] == trees[0][0] and sorted(x[2]) == sorted(trees[0][2]) for x in trees)
        f, closed, joints = trees[0]
        assert not f.tail_a and not f.tail_b
        assert closed + len(joints) + 1 == len(whole(both, text))


def test_ranges_cover_the_text_once():
    rnd = random.Random(5)
    for _ in range(200):
        text = "".join(rnd.choices(["a", "bcd", " ", "  ", "é", "\n", "日", "x" * 9], k=rnd.randrange(1, 60))).encode()
        parts = alignment.ranges(text, 7)
        data, at = b" " + text, 0
        for i, (number, window, lo, hi) in enumerate(parts):
            assert number == i
            assert window[lo:hi] == data[at:at + hi - lo]
            at += hi - lo
        assert at == len(data)


def test_parts_of_a_document_stay_together_where_joins_are_split(spark, both):
    """Adaptive execution may split a skewed join's partitions; each document still has one digest."""
    rnd = random.Random(9)
    words = [w for t in HARD if t and "▁" not in t for w in t.split(" ")]
    rows = [(i, " ".join(rnd.choices(words, k=300))) for i in range(6)] + [(10 + i, "small text " * 20) for i in range(10)]
    tight = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "16k"}
    before = {k: spark.conf.get(k, None) for k in tight}
    try:
        for k, v in tight.items():
            spark.conf.set(k, v)
        got = run(spark, rows, chunk=64)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == brute(both, rows)


def test_digests_read_parts_that_were_dealt_out_by_document(spark):
    df = spark.createDataFrame([(1, "a few words of a text " * 9)], "doc_id long, text string")
    plan = alignment.align(df, chunk=32)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(row#\d+L, \d+\), REPARTITION_BY_COL", plan)
