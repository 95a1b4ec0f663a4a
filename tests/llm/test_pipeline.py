import os
from collections import Counter

import corpus_pipeline as cp
from bitdex.llm import decontaminate, jaccard, langid, substrings
from bitdex.llm.mixing import mixed
from bitdex.session import ensure_checkpoint_dir


def test_stages_take_effect(spark, sf001, tmp_path):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    seen = docs
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf001)
        assert out.columns == seen.columns and out.dtypes == seen.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert set(after) == set(before)                     # all of these are languages
        elif name == "jaccard_join":
            source = spark.createDataFrame(list(before.values()), seen.schema)
            groups = {r.doc_id: r.component_id for r in jaccard.near_duplicates(source).collect()}
            assert set(after) == set(groups.values())
        elif name == "substring_dedup":
            assert set(after) == set(before)
            words = [r.text.split() for r in after.values()]
            assert all(after[i].n_chars == len(after[i].text) for i in after if after[i].text != before[i].text)
            was = Counter(tuple(w[i:i + 35]) for r in before.values() for w in [r.text.split()] for i in range(len(w) - 34))
            repeated = {x for x, n in was.items() if n > 1}
            now = Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
            assert not repeated & set(now)
        else:
            source = spark.createDataFrame(list(before.values()), seen.schema)
            bad = {r.doc_id for r in decontaminate.leaks(source, spark.read.parquet(f"{sf001}/benchmark.parquet")).collect()}
            assert bad and set(after) == set(before) - bad
    last = cp.STAGES[-1][1](spark, docs, sf001)
    assert {r.doc_id for r in last.collect()} == set(after)
    ran = cp.run(spark, sf001)
    assert sorted(map(str, ran.collect())) == sorted(map(str, mixed(docs).collect()))


def test_every_stage_on_odd_rows(spark, sf001):
    long = " ".join(f"le{i % 977} la{i % 13}" for i in range(30000))
    rows = [(1, "the house of the night " * 30, "en", "a", 5), (1, "the house of the night " * 30, "en", "a", 5),
            (None, None, None, None, None), (None, "", "fr", None, 0), (2, long, "fr", "b", None), (3, "das ist nicht schön", "de", None, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rk string, size int, _kept int, component_id long"
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], schema)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, sf001)
        got = out.collect()
        assert out.columns == df.columns and {r.rk for r in got} <= {"x"}
        assert stage(spark, df.limit(0), sf001).collect() == []
        if name == "jaccard_join":
            assert len(got) == 5
        if name == "substring_dedup":
            assert len(got) == 6
    assert len(cp.mix(spark, df, sf001).collect()) == 6 and cp.mix(spark, df.limit(0), sf001).collect() == []


def test_docs_of_a_stage_go_when_the_next_are_written(spark, sf001, monkeypatch):
    top = os.path.join(ensure_checkpoint_dir(spark), f"bitdex-{spark.sparkContext.applicationId}")

    def named(name):
        return sum(x.startswith(f"pipeline-{name}-") for x in os.listdir(top))
    monkeypatch.setattr(cp, "STAGES", [(x, lambda s, docs, d: docs.limit(5)) for x in ("one", "two", "three", "last")])
    assert cp.run(spark, sf001).count() == 5
    assert (named("one"), named("two"), named("three")) == (0, 0, 1)
