"""Connected components by contraction: every node moves to the neighbour that comes first in
an order shuffled anew each time (so that no numbering of the nodes makes long chains), edges
between the places are what is left. Tables only, no graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of ``edges``; equal labels: connected. The label is
    one of the nodes. Loops and repeated edges are legal, and a node that has only a
    loop is labelled too; nulls are not."""
    # written first: both directions must come from one evaluation of the edges
    pairs = cut_lineage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")), "pairs")
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
                       .distinct(), "edges")
    where, level = None, 0
    while True:
        level += 1
        first = F.min(F.struct(F.xxhash64(F.lit(level), "v").alias("h"), "v"))
        step = both.groupBy("u").agg(first.alias("m")).select("u", F.when(
            F.col("m.h") < F.xxhash64(F.lit(level), "u"), F.col("m.v")).otherwise(F.col("u")).alias("to"))
        step = cut_lineage(step, "step")
        if where is None:
            where = step.select(F.col("u").alias("node"), F.col("to").alias("label"))
        else:
            moved = where.join(step.select(F.col("u").alias("label"), "to"), "label", "left")
            where = moved.select("node", F.coalesce("to", "label").alias("label"))
        where = cut_lineage(where, "labels")
        to = step.select("u", F.col("to").alias("x"))
        left = (both.filter("u <> v").join(to, "u")
                .join(to.select(F.col("u").alias("v"), F.col("x").alias("y")), "v")
                .filter("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
        both = cut_lineage(left, "edges")
        if both.isEmpty():
            return where
