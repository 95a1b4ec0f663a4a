"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (alignment, decontaminate, html, jaccard, langid, licenses, merkle, mixing, oracle, phrases,
               substrings, topk, urls, warc)
from .common import table


def mix_targets(spark, sf):
    """What SQL can say of the mix: sizes and targets."""
    got = mixing.op2_mixing(spark, sf)
    return got.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def license_phrases(spark, sf):
    """What SQL can say of the license scan: the base phrases."""
    return licenses.op4_licenses(spark, sf).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def url_rules(spark, sf):
    """What SQL can say of the URL filter: host, path and rule."""
    pages = table(spark, sf, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"),
                                             urls.path_of(F.col("url")).alias("path"))
    return pages.withColumn("rule", urls.rule_of(F.col("host"), F.col("path"))[0])


def edited_texts(spark, sf):
    """What SQL can say of the fingerprints: the edited texts."""
    return merkle.op8_fingerprints(spark, sf).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {f.__name__: f for f in (
    html.op1_main_text,
    mixing.op2_mixing,
    substrings.op3_substring_dedup,
    licenses.op4_licenses,
    urls.op5_url_filter,
    warc.op6_warc,
    decontaminate.op7_decontamination,
    merkle.op8_fingerprints,
    jaccard.op9_jaccard_join,
    langid.op10_language_id,
    phrases.op11_collocations,
    topk.op12_topk,
    alignment.op13_alignment,
    mix_targets,
    license_phrases,
    url_rules,
    edited_texts,
)}
ORACLE: dict[str, str] = {
    "op3_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op9_jaccard_join": oracle.JACCARD_JOIN,
    "op11_collocations": oracle.COLLOCATIONS,
    "op12_topk": oracle.TOP_PRODUCTS,
    "mix_targets": oracle.MIX_TARGETS,
    "license_phrases": oracle.LICENSE_PHRASES,
    "url_rules": oracle.URL_RULES,
    "edited_texts": oracle.EDITED_TEXTS,
}
