"""Token tables and profiles.

Tokens are produced per row with ``regexp_extract_all`` on the folded text
(no shuffle); ``posexplode`` turns them into ``(id, pos, token)`` rows only
when a table form is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def token_table(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pos, token) for every basic token of every text."""
    return df.select(F.col(id_col).alias("id"),
                     F.posexplode(tx.tokenize(text_col)).alias("pos", "token"))


def token_profile(df: DataFrame, id_col: str = "id", text_col: str = "text",
                  max_tokens: int = 510) -> DataFrame:
    """(id, n_tokens, n_punct, over_context) per text (F9): one regex count and one
    character map, no token is built. Every punctuation character is its own token."""
    folded = df.select(F.col(id_col).alias("id"), tx.fold_text(text_col).alias("_f"))
    sized = folded.select(
        "id", F.regexp_count("_f", F.lit(tx.TOKEN_PATTERN)).alias("n_tokens"),
        (F.length("_f") - F.length(F.translate("_f", tx.PUNCT, ""))).alias("n_punct"))
    return sized.select("id", "n_tokens", "n_punct", (F.col("n_tokens") > max_tokens).alias("over_context"))


def corpus_profile(corpus: DataFrame, cap: int = tx.DEFAULT_CAP,
                   long: int = tx.DEFAULT_LONG) -> DataFrame:
    """Articles, share within the cap, long and extractive counts (A10): one
    aggregation with map-side partials."""
    from .units import route_columns
    r = route_columns(corpus, long)
    within = F.length("text") <= cap
    return r.agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.count_if(within).alias("n_within_cap"),
        F.round(F.avg(F.when(within, 1.0).otherwise(0.0)), 6).alias("share_within_cap"),
        F.count_if(tx.is_long("text", long)).alias("n_long"),
        F.count_if(F.col("extractive")).alias("n_extractive"))
