"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A text is cut without loss: sections start after a blank line, paragraphs after a
line feed, pieces (the leaves) after a punctuation mark and white space, or after
256 characters. A leaf's hash is the hash of its characters, a node's that of its
children's hashes; the root tests equality. The fingerprint is
``root/piece.piece,piece;piece``: the root, then the leaves' hashes with ``,``
between paragraphs and ``;`` between sections, so it holds the whole tree and
differing branches locate edits. Column functions only; equal texts have equal
fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import row_key, table

SECTION = r"(?<=\n\n)(?=[^\n])"
PARAGRAPH = r"(?<=\n)"
PIECE = r"(?s).{1,256}?(?:[.!?;,|:]\s|\z)|.{256}"


def tree(text: Column) -> Column:
    """Hashes of the pieces, by section and paragraph: array<array<array<bigint>>>."""
    def pieces(paragraph):
        return F.transform(F.regexp_extract_all(paragraph, F.lit(PIECE), F.lit(0)),
                           lambda x: F.xxhash64(x))

    def paragraphs(section):
        return F.transform(F.filter(F.split(section, PARAGRAPH), lambda x: x != ""), pieces)

    return F.transform(F.filter(F.split(text, SECTION), lambda x: x != ""), paragraphs)


def leaves(tree_col: Column) -> Column:
    """Distinct leaf hashes of a tree."""
    return F.array_distinct(F.flatten(F.flatten(tree_col)))


def fingerprint(tree_col: Column) -> Column:
    """The tree as a string."""
    def short(h):
        return F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))

    nodes = F.transform(tree_col, lambda s: F.xxhash64(F.transform(s, lambda p: F.xxhash64(p))))
    root = F.substring(F.sha2(F.array_join(F.transform(nodes, lambda h: h.cast("string")), ","), 256), 1, 32)
    body = F.array_join(F.transform(tree_col, lambda s: F.array_join(F.transform(
        s, lambda p: F.array_join(F.transform(p, short), ".")), ",")), ";")
    return F.concat(root, F.lit("/"), body)


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of leaves: 1 for equal texts (empty ones too), 0
    if they share no piece."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(
        F.lit(2.0) * F.size(F.array_intersect(a, b)) / F.greatest(total, F.lit(1)))


def root_of(fp: Column) -> Column:
    return F.split_part(fp, F.lit("/"), F.lit(1))


def changed(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: array<struct<section, paragraph>> from 0, in the
    order of the texts; empty if the roots agree. Branches whose hashes agree are
    not entered."""
    def sections(fp):
        return F.split(F.split_part(fp, F.lit("/"), F.lit(2)), ";")

    def both(x, y):
        n = F.greatest(F.size(x), F.size(y))
        return F.transform(F.sequence(F.lit(0), n - 1),
                           lambda i: F.struct(i.alias("i"), F.get(x, i).alias("x"), F.get(y, i).alias("y")))

    def paragraphs(s):
        x, y = (F.split(F.coalesce(s[k], F.lit("")), ",") for k in ("x", "y"))
        return F.transform(F.filter(both(x, y), lambda p: ~p["x"].eqNullSafe(p["y"])),
                           lambda p: F.struct(s["i"].alias("section"), p["i"].alias("paragraph")))

    differ = F.filter(both(sections(a), sections(b)), lambda s: ~s["x"].eqNullSafe(s["y"]))
    return F.when(root_of(a) == root_of(b), F.array().cast("array<struct<section:int,paragraph:int>>")
                  ).otherwise(F.flatten(F.transform(differ, paragraphs)))


def neighbours(docs: DataFrame, id: str, key: str, n: str) -> DataFrame:
    """(i, k, same, prev): each distinct (id, key), how many rows have it, and (i, k, n) of the
    one before in ascending order of id (nulls first), then key; before the first comes
    the last.

    Only ids travel. They are dealt out by range, so no task sees more than its
    range, and one row for each range settles the borders.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id).alias("i"), F.col(key).alias("k"), F.col(n).alias("n")).groupBy(
        "i", "k", "n").agg(F.count("*").alias("same"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = cut_lineage(ids.repartitionByRange(parts, F.col("i").asc_nulls_first(), "k")
                      .withColumn("range", F.spark_partition_id()), "neighbours")
    edge = (ids.groupBy("range")
            .agg(F.max_by(F.struct("i", "k", "n"), F.struct(F.col("i").isNotNull(), "i", "k")).alias("last")))
    order = Window.orderBy("range")                      # one row for each range
    edge = edge.select("range", F.lag("last").over(order).alias("before"),
                       F.last("last").over(order.rowsBetween(Window.unboundedPreceding,
                                                             Window.unboundedFollowing)).alias("final"))
    within = Window.partitionBy("range").orderBy(F.col("i").asc_nulls_first(), "k")
    prev = F.coalesce(F.lag(F.struct("i", "k", "n")).over(within), "before", "final")
    return ids.join(F.broadcast(edge), "range").select("i", "k", "same", prev.alias("prev"))


def edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, whose last half is
    replaced by the start of the next document.

    Null text counts as empty. Documents are ordered by id, nulls first; rows with
    one id are ordered by a hash of the text, and repeated rows count as one
    document in that order (each of them is returned). A single document is its own
    next; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("k", row_key("doc_id", "text"))
    near = cut_lineage(neighbours(rows.withColumn("n", F.length("text")), "doc_id", "k", "n"), "neighbours")
    repeated = not near.filter("same > 1").isEmpty()

    def joined(other):
        """Both joins read the texts dealt out by the same columns, so they travel once."""
        return rows.join(other, (rows.k == other.at_k) & rows.doc_id.eqNullSafe(other.at_i))

    starts = joined(near.select(F.col("i").alias("at_i"), F.col("k").alias("at_k"), "prev")).select(
        F.col("prev.i").alias("at_i"), F.col("prev.k").alias("at_k"),
        F.expr("substring(text, 1, cast(floor(prev.n / 2) AS int))").alias("start"),
        leaves(tree(F.col("text"))).alias("next_leaves"))
    if repeated:
        starts = starts.dropDuplicates(["at_i", "at_k"])
    both = joined(starts).withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn(
        "edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) AS int))"), "start"))
    both = both.withColumn("tree", tree(F.col("text"))).withColumn("edited_tree", tree(F.col("edited")))
    both = both.withColumn("leaves", leaves(F.col("tree")))
    return both.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), leaves(F.col("edited_tree"))).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and the next document."""
    return edits(table(spark, sf_dir, "documents"))
