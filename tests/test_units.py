"""Extractive selection (C1, G1, J1, W1, W2, T2): literal inputs with literal bodies,
and properties."""

import pytest
from pyspark.sql import functions as F

from bitdex.operators import units as un
from bitdex.operators.encode import HashPoolEncoder
from bitdex.sources.corpus import documents_corpus

SCHEMA = "id long, title string, text string"
PAIRS = "u array<string>, s array<double>"


def _select(spark, units, scores, cap):
    df = spark.createDataFrame([(units, scores)], PAIRS)
    return df.select(un.select_units(F.col("u"), F.col("s"), cap)).first()[0]


def _bodies(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.id: (r.title, r.body) for r in
            un.build_bodies(df, encoder=HashPoolEncoder(dim=128), **options).collect()}


def test_short_texts_take_their_lead(spark):
    rows = [(1, None, "tiny"), (2, "a\tb", " Two  spaces.\nNext line. "), (3, "  ", "   \n  "), (4, "t", None),
            (5, "", ""), (6, "cut", "First one. Second one is long.")]
    assert _bodies(spark, rows, cap=24) == {
        1: ("", "tiny"), 2: ("a b", "Two spaces. Next line."), 6: ("cut", "First one.")}


def test_long_text_takes_the_units_like_its_title(spark):
    filler = [f"Filler paragraph number {i} says nothing at all." for i in range(3)]
    text = "\n\n".join([filler[0], "Otters swim.", filler[1], "Otters eat fish.", filler[2]])
    got = _bodies(spark, [(1, "otters swim eat fish", text)], cap=30, long=50)
    assert got == {1: ("otters swim eat fish", "Otters swim. Otters eat fish.")}
    # fewer than four units: the lead, however long the text
    assert _bodies(spark, [(2, "fish", "Only one. Two here. Three fish.")], cap=10, long=20) == {
        2: ("fish", "Only one. ".strip())}


@pytest.mark.parametrize("units,scores,cap,want", [
    (["a" * 700, "b" * 600, "c" * 100], [0.9, 0.8, 0.7], 1200, "a" * 700),          # stop, don't skip
    (["x " * 900, "short one."], [0.9, 0.1], 1200, ("x " * 900)[:1200]),            # the first is cut
    (["u0 u0", "u1 u1", "u2 u2"], [0.5, 0.5, 0.5], 12, "u0 u0 u1 u1"),              # ties: earlier first
    (["one.", "two.", "three."], [0.1, 0.9, 0.5], 12, "two. three."),               # document order
    (["last", "first"], [0.0, 1.0], 5, "first"),
])
def test_budget(spark, units, scores, cap, want):
    assert _select(spark, units, scores, cap) == want


def test_properties_of_documents(spark, sf001):
    corpus = documents_corpus(spark, sf001)
    got = {r.id: r for r in un.build_bodies(corpus, encoder=HashPoolEncoder(), keep_route=True).collect()}
    texts = {r.id: " ".join(r.text.split()) for r in corpus.collect()}
    assert set(got) == set(texts)
    routes = [r.extractive for r in got.values()]
    assert any(routes) and not all(routes)
    for i, r in got.items():
        assert 0 < len(r.body) <= 1200
        if r.extractive:        # every chosen sentence stands in the text, in that order
            at = 0
            for piece in r.body.replace("! ", "!|").replace("? ", "?|").replace(". ", ".|").split("|"):
                found = texts[i].find(piece, at)
                assert found >= 0
                at = found
        else:
            assert texts[i].startswith(r.body)
    again = un.build_bodies(corpus.repartition(7), encoder=HashPoolEncoder()).collect()
    assert {r.id: r.body for r in again} == {i: r.body for i, r in got.items()}


def test_worklist_and_window_forms(spark):
    rows = [(1, 0, "aaa", 0.2), (1, 1, "bb", 0.9), (1, 2, "cccc", 0.9), (1, 3, "d", 0.1),
            (2, 0, "z" * 20, 0.3), (2, 1, "y" * 20, 0.4)]
    df = spark.createDataFrame(rows, "id long, pos int, unit string, score double")
    chosen = un.budget_units(un.rank_units(df), 10)
    assert {r.id: r.body for r in un.restore_order(chosen, 10).collect()} == {1: "bb cccc", 2: "y" * 10}
    corpus = spark.createDataFrame([(1, None, "Aa one. Bb two. Cc three. Dd four."), (2, "t", "short")], SCHEMA)
    got = sorted(map(tuple, un.extraction_worklist(corpus, long=20).collect()))
    assert got == [(1, -1, "article"), (1, 0, "Aa one."), (1, 1, "Bb two."), (1, 2, "Cc three."), (1, 3, "Dd four.")]


def test_one_huge_article(spark):
    """100,000 units of one article over 20 partitions: each task sends its best few, and the choice is that of the
    whole ranking."""
    scored = spark.range(100_000, numPartitions=20).select(
        F.lit(1).alias("id"), F.col("id").cast("int").alias("pos"),
        F.concat(F.lit("unit "), F.col("id").cast("string")).alias("unit"),
        (F.pmod(F.xxhash64("id"), F.lit(5000)) / 5000.0).alias("score"))
    few = spark.createDataFrame([(2, 0, "a" * 2000, 0.1), (2, 1, "bb", 0.05), (3, 0, "c", 0.9), (3, 1, "", 0.8)],
                                "id int, pos int, unit string, score double")
    scored = scored.unionByName(few)
    got = un.chosen_units(scored, 1200)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    want = un.budget_units(un.rank_units(scored.filter("unit <> ''")), 1200)
    key = lambda df: sorted((r.id, r.pos, r["rank"]) for r in df.collect())          # noqa: E731
    assert key(got) == key(want)
    assert [r for r in key(got) if r[0] > 1] == [(2, 0, 1), (3, 0, 1)]
