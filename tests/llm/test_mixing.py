import re
from collections import defaultdict

import pytest

from bitdex.llm import mixing


def check(rows, tolerance=1):
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= tolerance
        assert rs[0]["source_size"] == sum(r["size"] for r in rs)
        full = min(rs[0]["target"] // max(1, rs[0]["source_size"]), 2)
        assert all(r["taken"] >= full * r["size"] for r in rs)      # no repeat before all are taken
    total = sum(r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * total, abs=len(by) + 1)


def test_documents(spark, sf001):
    got = [r.asDict() for r in mixing.op2_mixing(spark, sf001).collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    assert {r["doc_id"]: r["size"] for r in got} == \
        {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    check(got)
    again = mixing.op2_mixing(spark, sf001).collect()
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in again)


def test_nulls_ties_and_empty(spark):
    schema = "doc_id long, text string, source string, size int, _h string"
    rows = [(i, "a b c d", "x", 1, "h") for i in range(50)] + [(7, "same row", None, 2, "")] * 9 \
        + [(None, None, "y", 0, None), (None, "", "y", 0, None), (3, "w " * 500, "z", 0, "")]
    got = [r.asDict() for r in mixing.mixed(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == len(rows)
    check(got, tolerance=10)                     # nine equal rows share alike
    assert len({r["taken"] for r in got if r["source"] is None}) == 1
    assert mixing.mixed(spark.createDataFrame([], schema)).collect() == []


def test_targets_share_the_excess_again(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows, 1665, (3.0, 1.0, 2.0), 2).collect()}
    assert got["a"] == 20 and got["c"] == 200 and got["b"] == pytest.approx(1445)
    rows = spark.createDataFrame([(None, 10), ("\U0001F600", 5), ("\uFFFD", 7)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows, 1e9, (3.0, 1.0, 2.0), 2).collect()}
    assert got == {"\uFFFD": 14, "\U0001F600": 10, None: 20}                 # all full
    got = {r.source: r.target for r in mixing.source_targets(rows, 6, (3.0, 1.0, 2.0), 2).collect()}
    assert got == {"\uFFFD": 3, "\U0001F600": 1, None: 2}                     # by code point, null last


def test_flow_takes_unrepeated_words_first():
    # 30 words in a alone, 30 in both, b has 10 of its own: b's 40 come from its own and the shared
    given = mixing.route({("a",): 30, ("a", "b"): 30, ("b",): 10}, {"a": 30, "b": 40}, 2)
    assert given == {("a",): 30, ("a", "b"): 30, ("b",): 10}
    given = mixing.route({("a",): 30, ("a", "b"): 30, ("b",): 10}, {"a": 60, "b": 40}, 2)
    assert sum(given.values()) == 100 and all(given[p] >= n for p, n in
                                              {("a",): 30, ("a", "b"): 30, ("b",): 10}.items())


def brute_cost(patterns, targets, repeats):
    """(most words, least cost) over all flows, by trying each pattern's amounts."""
    import itertools
    names = list(patterns)
    best = (0, 0)
    for amounts in itertools.product(*[range(repeats * patterns[p] + 1) for p in names]):
        # can the amounts be sent to the sources? (Hall's condition over sets of sources)
        ends = sorted(targets)
        if any(sum(a for a, p in zip(amounts, names) if set(p) <= set(group)) > sum(targets[s] for s in group)
               for k in range(1, len(ends) + 1) for group in itertools.combinations(ends, k)):
            continue
        cost = sum(max(0, a - e * patterns[p]) for a, p in zip(amounts, names) for e in range(1, repeats))
        best = min(best, (-sum(amounts), cost))
    return best


def test_flow_against_brute_force():
    import random
    rnd = random.Random(8)
    for _ in range(60):
        sources = ["a", "b", "c"][:rnd.randrange(1, 4)]
        patterns = {tuple(sorted(rnd.sample(sources, rnd.randrange(1, len(sources) + 1)))): rnd.randrange(1, 4)
                    for _ in range(rnd.randrange(1, 4))}
        targets = {s: rnd.randrange(0, 7) for s in sources}
        given = mixing.route(patterns, {s: targets[s] for s in targets}, 2)
        cost = sum(max(0, given[p] - patterns[p]) for p in patterns)
        assert (-sum(given.values()), cost) == brute_cost(patterns, targets, 2)


def test_overlapping_sources(spark):
    rows = [(i, ["a"] if i % 3 else ["a", "b"], 10) for i in range(300)] + [(1000, [], 5)]
    df = spark.createDataFrame(rows, "doc_id long, s array<string>, size long")
    out, targets = mixing.mix(df, "s", "size", share=0.5)
    taken = {r.doc_id: r.taken for r in out.collect()}
    targets = {r.source: r for r in targets.collect()}
    assert {s: r.source_size for s, r in targets.items()} == {"a": 3000, "b": 1000}
    assert sum(taken.values()) == pytest.approx(sum(r.target for r in targets.values()), abs=4)
    assert taken[1000] == 0 and max(taken.values()) <= 10


def test_many_sources_and_connected_patterns(spark):
    """Every document a source of its own; and chains of overlapping sources, each a network."""
    rows = [(i, [f"h{i:05d}"], 3 + i % 5) for i in range(3000)]
    rows += [(10_000 + 3 * i + j, s, 10) for i in range(40)
             for j, s in enumerate(([f"x{i}"], [f"x{i}", f"y{i}"], [f"y{i}", None] if i == 0 else [f"y{i}"]))]
    df = spark.createDataFrame(rows, "doc_id long, s array<string>, size long")
    out, targets = mixing.mix(df, "s", "size")
    want = {r.source: r for r in targets.collect()}
    assert len(want) == 3081
    taken = {r.doc_id: r.taken for r in out.collect()}
    for i, (h,), n in rows[:3000]:
        assert abs(taken[i] - min(want[h].target, 2 * n)) < 1
    for i in range(1, 40):
        sent = sum(taken[10_000 + 3 * i + j] for j in range(3))
        assert abs(sent - min(60, want[f"x{i}"].target + want[f"y{i}"].target)) <= 3
