"""The corpus pipeline: documents -> language ID -> near-duplicate join -> substring dedup ->
benchmark decontamination -> mix.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns a
DataFrame; ``run`` writes each stage's result as Parquet and rereads it as the next one's
docs, whereupon the docs before it and the shuffle files of the stage go. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitdex.llm import decontaminate, jaccard, langid, mixing, substrings
from bitdex.llm.common import by_key, free_shuffles, row_key, table
from bitdex.session import cut_lineage, drop_cut


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known; "und" rows (no letters, or like none of the languages) go."""
    found = langid.of_documents(docs)
    rejected = cut_lineage(found.filter(~F.col("kept")).select("rk").distinct(), "rejected")
    return by_key(docs, row_key("doc_id", "text"), rejected, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one of the smallest id (ties: of the
    smallest row key; repeated rows: one of them). Rows without words all stay."""
    found = cut_lineage(jaccard.near_duplicates(docs).select("doc_id", "rk", "n_shingles", "component_id"), "near")
    found = found.filter("n_shingles > 0")
    # ids may be null or shared: the first row of a group by (id, key), nulls last
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rk"))
    first = found.groupBy("component_id").agg(F.min(order).alias("_f")).select(F.col("_f.rk").alias("rk"))
    gone = cut_lineage(found.select("rk").distinct().join(first.distinct(), "rk", "left_anti"), "copies")
    kept = by_key(docs, row_key("doc_id", "text"), gone, "left_anti")
    free_shuffles(spark)
    again = found.groupBy("rk").count().filter("count > 1").join(gone, "rk", "left_anti")
    if again.isEmpty():
        return kept
    again = cut_lineage(again.select("rk"), "repeated")      # rows that agree in id and text
    once = by_key(kept, row_key("doc_id", "text"), again, "left_semi").dropDuplicates(["doc_id", "text"])
    return by_key(kept, row_key("doc_id", "text"), again, "left_anti").unionByName(once)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; words covered by repeated 35-word windows are cut out of the texts, and
    ``n_chars`` follows. Texts that lose nothing stay as they are."""
    out = substrings.cut_repeats(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out.select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the words the mix takes of each: doc_id, size, source_size, target, taken."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_cut(*written)
        written = [docs]
        free_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the hashing, flow and language stages; tests/llm holds them to brute force.
ORACLE_SQL = None
