import random

from pyspark.sql import functions as F

from bitdex.llm import langid

WORDS = {"en": "the of and that with from this house water night".split(),
         "de": "der die das und nicht auch über straße schön zeit".split(),
         "fr": "le la les été avec pour être château eau nuit".split()}


def text(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, d string, h string, like int")


def test_fusion(spark):
    rnd = random.Random(1)
    rows = [(i, text(rnd, lang, rnd.randrange(20, 60)), lang, f"{lang}{i % 3}.example.{lang}", 0)
            for i, lang in enumerate(list(WORDS) * 60)]
    extra = [(900, text(rnd, "de", 40), "en-GB", "en1.example.en", 0),      # text outweighs a wrong declaration
             (901, "xq", "fr", None, 0),                                    # little text: declared
             (902, "q", None, "de0.example.de", 0),                         # little text: host
             (903, "q", None, "new.example.fr", 0),                         # an unseen host: its suffix
             (904, None, "en", None, 0), (905, "", None, None, 0), (906, "12 34 !!", "de", None, 0),
             (907, "".join(chr(97 + rnd.randrange(26)) for _ in range(3000)), "en", None, 0),     # noise
             (None, text(rnd, "fr", 30000), None, None, 0), (908, rows[0][1], "en", "x", 0), (908, rows[0][1], "en", "x", 0)]
    df = frame(spark, rows + extra)
    out = langid.identify(df, declared=F.col("d"), host=F.col("h"), suffix=langid.suffix_of(F.col("h")))
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows) + len(extra)
    assert all(got[i][0].predicted == rows[i][2] and got[i][0].kept for i in range(len(rows)))
    assert [got[i][0].predicted for i in (900, 901, 902, 903)] == ["de", "fr", "de", "fr"]
    assert all(not got[i][0].kept and got[i][0].predicted == "und" for i in (904, 905, 906, 907))
    assert got[None][0].predicted == "fr" and got[908][0] == got[908][1]
    assert all(0 <= r[0].posterior <= 1 for r in got.values())


def test_empty_and_undeclared(spark):
    assert langid.identify(frame(spark, []), declared=F.col("d")).collect() == []
    [r] = langid.identify(frame(spark, [(1, "the house", None, None, 0)]), declared=F.col("d")).collect()
    assert r.predicted == "und" and not r.kept


def test_held_out_accuracy_of_documents(spark, sf001):
    """The declared language hidden from a third of the rows is found from the other evidence."""
    docs = spark.read.parquet(f"{sf001}/documents.parquet").withColumn(
        "d", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    got = {r.doc_id: r for r in langid.identify(docs, declared=F.col("d"), host=F.col("source")).collect()}
    hidden = [r for r in docs.collect() if r.d is None]
    right = sum(got[r.doc_id].predicted == r.lang for r in hidden)
    assert right >= 0.95 * len(hidden)
    kept = [r.kept for r in langid.op10_language_id(spark, sf001).collect()]
    assert len(kept) == docs.count() and all(kept)


def test_pages(spark, sf001):
    pages = spark.read.parquet(f"{sf001}/pages.parquet")
    got = {r.doc_id: r for r in langid.identify_pages(pages).collect()}
    rows = pages.select("page_id", langid.markup_code(F.col("html")).alias("lang")).collect()
    assert sum(got[r.page_id].predicted == r.lang for r in rows) >= 0.95 * len(rows)


def test_every_declared_language_is_learnt(spark, monkeypatch):
    """More languages than 64, each with words of its own; the rarest is found, also in small steps."""
    rnd = random.Random(3)
    codes = [a + b for a in "abcdefgh" for b in "mnopqrstuv"]
    words = {c: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for c in codes}
    rows = [(i, " ".join(rnd.choice(words[c]) for _ in range(40)), c if i < 80 * 3 else None, f"h{c}.x.{c}", 0)
            for i, c in enumerate(codes * 4) if i < 80 or c != "hv" or i >= 80 * 3]
    df = frame(spark, rows)

    def found():
        out = langid.identify(df, declared=F.col("d"), host=F.col("h"), suffix=langid.suffix_of(F.col("h")))
        return sorted((r.doc_id, r.predicted, r.kept, r.posterior) for r in out.collect())

    got = found()
    assert [x[:3] for x in got] == [(r[0], codes[r[0] % 80], True) for r in sorted(rows)]
    monkeypatch.setattr(langid, "LANGUAGES", 7)
    monkeypatch.setattr(langid, "CELLS", 200)
    assert [x[:3] for x in found()] == [x[:3] for x in got]
