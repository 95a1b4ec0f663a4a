"""Corpus and record sources/sinks.

* ``read_corpus``: a parquet scan of (id, title, text) -- Catalyst prunes the
  scan to exactly those columns (``ReadSchema``).
* ``documents_corpus``: the corpus view over the driver's ``documents`` table,
  which has no title column (title = the whole first line).
* ``parse_records`` / ``read_records``: ``id<TAB>title<TAB>text`` lines, split
  at the first two tabs only; lines with fewer than two tabs are dropped.
* ``record_lines`` / ``write_records``: the same lines out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_corpus(spark: SparkSession, path: str, id: str = "id",
                title: str = "title", text: str = "text", address: bool = False) -> DataFrame:
    """Scan three columns of a parquet corpus as (id, title, text) (S1); ``address`` adds
    ``file`` and ``position`` (the row's place in it), the corpus order."""
    return spark.read.parquet(path).select(
        F.col(id).alias("id"), F.col(title).alias("title"),
        F.col(text).alias("text"), *(_address() if address else []))


def _address() -> list:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("position")]


def documents_corpus(spark: SparkSession, sf_dir: str, address: bool = False) -> DataFrame:
    """(id, title, text) over ``documents``: title = the whole first line; with ``address``
    also (file, position)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"),
                       tx.first_line_title("text").alias("title"),
                       F.col("text"), *(_address() if address else []))


def parse_records(lines: DataFrame, col: str = "value") -> DataFrame:
    """``id<TAB>title<TAB>text`` -> (id, title, text) strings.

    Only the first two tabs split; later tabs stay in the text. Lines with
    fewer than two tabs are dropped silently.
    """
    parts = F.split(F.col(col), "\t", 3)
    return (lines.select(parts.alias("_p"))
            .filter(F.size("_p") == 3)
            .select(F.col("_p")[0].alias("id"), F.col("_p")[1].alias("title"),
                    F.col("_p")[2].alias("text")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Read record lines; only ``\\n`` ends a line, so ``\\r`` is kept."""
    return parse_records(spark.read.option("lineSep", "\n").text(path))


def record_lines(bodies: DataFrame, id: str = "id", title: str = "title",
                 body: str = "body") -> DataFrame:
    """One ``id<TAB>title<TAB>body`` string per row (S3); title cleaned."""
    return bodies.select(F.concat_ws(
        "\t", F.col(id).cast("string"), tx.clean_title(title), F.col(body)
    ).alias("value"))


def write_records(bodies: DataFrame, path: str, **cols) -> None:
    record_lines(bodies, **cols).write.mode("overwrite") \
        .option("lineSep", "\n").text(path)
