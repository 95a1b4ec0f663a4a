"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks,
weighted-shingle verification. Column functions and joins only.

1. Texts are normalised to words of letters and digits (lower case); shingles are 5
   words (a shorter item is one shingle).
2. Alignment: the item side (the benchmark, small beside the corpus) is joined to
   every shingle of every text. A shared shingle puts an item-sized window on the
   text: it starts where the item would start. A window similar to an item by
   ``SIMILARITY`` shares a shingle with it, so no window that counts is missed;
   windows without a shared shingle can't reach the similarity and get no SimHash.
3. Each window and each item gets a 64-bit SimHash of its shingles, weighted by count.
4. Multi-index Hamming search: fingerprints are cut into ``BLOCKS`` blocks. Two
   fingerprints within ``RADIUS`` bits agree, in at least one block, up to
   RADIUS // BLOCKS bits (pigeonhole). Each item is indexed under all block values that
   close; a window looks up its own block values, so every item within the radius is
   found and then confirmed by the whole distance.
5. The weighted Jaccard similarity of shingle counts verifies the candidates exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import BROADCAST_KEYS, by_key, row_key, table

SHINGLE = 5
SIMILARITY = 0.75
BITS = 64
BLOCKS = 8
RADIUS = 23         # 2 bits in one of 8 blocks at least; see the README for the recall measured
WORD_CHARS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case words of letters and digits; an empty array for null."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORD_CHARS, " "))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def shingles(w: Column, k: int = SHINGLE) -> Column:
    """Hashes of all k-word shingles in order; of the whole, if shorter; none if empty."""
    n = F.size(w)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))),
                    lambda i: F.xxhash64(F.slice(w, i, k))))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash; a shingle weighs as often as it occurs. Bit b is set if more
    shingle hashes have it than not."""
    n = F.size(hashes)
    counts = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.size(
        F.filter(hashes, lambda h: F.getbit(h, b) == 1)))
    return F.aggregate(
        F.zip_with(counts, F.sequence(F.lit(0), F.lit(BITS - 1)), lambda c, b: F.when(
            c * 2 > n, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays: sum of the lesser counts over sum of the greater."""
    def count(x, h):
        return F.size(F.filter(x, lambda y: y == h))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0),
                         lambda acc, h: acc + F.least(count(a, h), count(b, h)))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, 0.0).otherwise(common / F.greatest(total, F.lit(1)))


def near_values(radius: int, blocks: int) -> list[int]:
    """All block masks with up to radius // blocks bits set."""
    width = BITS // blocks
    return [sum(1 << b for b in bits) for n in range(radius // blocks + 1)
            for bits in combinations(range(width), n)]


def hamming_join(windows: DataFrame, items: DataFrame, radius: int = RADIUS,
                 blocks: int = BLOCKS) -> DataFrame:
    """Pairs of a window (``w_sim``) and an item (``i_sim``) of the same ``size`` whose fingerprints differ in at
    most ``radius`` bits, each pair once."""
    width = BITS // blocks

    def block(col, i):
        return F.shiftrightunsigned(col, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))

    def keyed(df, col):
        parts = F.array(*[F.struct(F.lit(i).alias("block"), block(F.col(col), i).alias("value"))
                          for i in range(blocks)])
        return df.withColumn("_b", F.explode(parts)).select("*", "_b.block", "_b.value").drop("_b")

    masks = F.array(*[F.lit(m).cast("bigint") for m in near_values(radius, blocks)])
    index = (keyed(items, "i_sim").withColumn("_m", F.explode(masks))
             .withColumn("value", F.col("value").bitwiseXOR(F.col("_m"))).drop("_m"))
    pairs = keyed(windows, "w_sim").join(index, ["size", "block", "value"])
    pairs = pairs.filter(F.bit_count(F.col("w_sim").bitwiseXOR(F.col("i_sim"))) <= radius)
    # once: in the first block that comes close enough
    near = [F.bit_count(block(F.col("w_sim").bitwiseXOR(F.col("i_sim")), i)) <= radius // blocks
            for i in range(blocks)]
    first = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(near)])
    return pairs.filter(F.col("block") == first).drop("block", "value")


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
          item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY,
          radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """(doc_id, rk, item_id, start, n_words, distance, similarity): for each text and item
    the window most like the item (ties: the first), if similar enough.

    ``rk`` keys the row (id and text), so null ids and rows that share an id stay
    apart; repeated rows give one line. Null or empty texts and items never match. Items
    of equal text each match. An empty table on either side gives an empty result.
    """
    # Written tables between the steps: else filters pushed through them repeat whole expressions.
    items = (benchmark.select(F.col(item).alias("item_id"), words(F.col(item_text)).alias("_w"))
             .filter(F.size("_w") > 0).distinct().withColumn("size", F.size("_w")))
    items = cut_lineage(items.select("item_id", "size", shingles(F.col("_w"), k).alias("i_sh")), "items")
    items = cut_lineage(items.withColumn("i_sim", simhash(F.col("i_sh"))), "items")
    places = cut_lineage(items.select("size", F.posexplode("i_sh").alias("i_at", "h"))
                         .groupBy("h", "size").agg(F.min("i_at").alias("i_at")), "places")
    small = places.count() <= BROADCAST_KEYS
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), row_key(id, text).alias("rk"))
    texts = rows.select("rk", words(F.col("text")).alias("w"))
    # short items are one shingle of all their words; texts are cut at those lengths too
    lengths = [r["size"] for r in items.filter(F.col("size") < k).select("size").distinct().collect()]
    hits = None
    for n in [k, *sorted(lengths)]:
        there = places.filter(F.col("size") >= k if n == k else F.col("size") == n)
        found = (texts.select("rk", F.posexplode(shingles(F.col("w"), n)).alias("at", "h"))
                 .join(F.broadcast(there) if small else there, "h"))
        hits = found if hits is None else hits.unionByName(found)
    starts = cut_lineage(hits.select("rk", "size", F.greatest(F.col("at") - F.col("i_at"), F.lit(0)).alias("start"))
                         .groupBy("rk").agg(F.collect_set(F.struct("size", "start")).alias("_starts")), "starts")
    if starts.count() <= BROADCAST_KEYS:
        starts = F.broadcast(starts)
    held = cut_lineage(rows.join(starts, "rk").select("doc_id", "rk", words(F.col("text")).alias("w"), "_starts"),
                       "held")
    windows = held.select("doc_id", "rk", "w", F.explode("_starts").alias("_s")).select(
        "doc_id", "rk", "_s.size", "_s.start", F.slice("w", F.col("_s.start") + 1, F.col("_s.size")).alias("w"))
    windows = cut_lineage(windows.select("doc_id", "rk", "size", "start", shingles(F.col("w"), k).alias("w_sh")),
                          "windows")
    windows = cut_lineage(windows.withColumn("w_sim", simhash(F.col("w_sh"))), "windows")
    pairs = hamming_join(windows, items, radius)
    scored = (pairs.withColumn("similarity", weighted_similarity(F.col("w_sh"), F.col("i_sh")))
              .filter(F.col("similarity") >= similarity)
              .withColumn("distance", F.bit_count(F.col("w_sim").bitwiseXOR(F.col("i_sim")))))
    best = F.max_by(F.struct("start", "size", "distance", "similarity", "doc_id"),
                    F.struct("similarity", -F.col("start")))
    return (scored.groupBy("rk", "item_id").agg(best.alias("b"))
            .select("b.doc_id", "rk", "item_id", "b.start", F.col("b.size").alias("n_words"),
                    "b.distance", "b.similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    found = cut_lineage(leaks(docs, benchmark, id, text, **options).select("rk").distinct(), "leaks")
    return by_key(docs, row_key(id, text), found, "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item: one row for each pair."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("rk")
