"""Mixing sources to target weights by min-cost flow.

1. Documents are aggregated by membership pattern (the set of sources a document
   belongs to): one size, in words, per pattern.
2. Each source gets a target: its weight's share of ``share`` x all words, at most
   ``repeats`` x its own words; what exceeds that is shared again by weight.
3. A small flow network routes words from patterns to source targets. A pattern's
   words cost 0 in their first epoch, 1 in the second, and so on (convex), so no
   document is repeated while another one that could serve has not been taken.
4. A pattern's flow becomes whole epochs for all of its documents and a seeded
   selection for the rest: documents below a threshold of a seeded hash are taken
   once more, those at the threshold share what is left.

The threshold is found by counting words in 1,024 hash bins of each pattern, four
times, each time inside the bin that holds the threshold: no sort, no window over the documents of
a pattern. Sources, patterns, targets, bins and thresholds are tables, whatever their number; a
source that shares no document with another gets its flow in closed form, and each connected set of
overlapping patterns (their sizes, not their documents) is one task's network. The driver
sees a few sums.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordinals import dense_ordinal
from ..session import cut_lineage
from .common import WORD, table
from .components import components

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2
SEED = 17
BITS, LEVELS = 10, 4


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, total: float, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """(source, source_size, .., target) written. Sources in code point order, null last, get the weights in
    turn and share ``total`` by them; nobody gets over ``repeats`` x its size, the excess is shared
    again by weight among the others. Each round finds those that are full, from two sums."""
    ordered = dense_ordinal(sizes.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "_rank")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = cut_lineage(ordered.withColumn("_weight", turn), "sources")
    most = F.lit(repeats) * F.col("source_size")
    left = float(min(total, repeats * (rows.agg(F.sum("source_size")).first()[0] or 0)))
    unit, full = 0.0, -1
    while True:
        over = F.lit(unit) * F.col("_weight") >= most
        s = rows.agg(F.count_if(over).alias("full"), F.sum(F.when(over, most).otherwise(0)).alias("given"),
                     F.sum(F.when(over, 0.0).otherwise(F.col("_weight"))).alias("weight")).first()
        if (s.full or 0) == full or not s.weight:
            break
        full, unit = s.full, max(unit, (left - s.given) / s.weight)
    target = F.when(F.lit(unit) * F.col("_weight") >= most, most.cast("double")).otherwise(F.lit(unit) * F.col("_weight"))
    return cut_lineage(rows.withColumn("target", target).drop("_none", "_rank", "_weight"), "targets")


def route(patterns: dict[tuple, int], targets: dict[object, int], repeats: int) -> dict[tuple, int]:
    """Min-cost flow: words each pattern gives. Arcs: start -> pattern, one for each
    epoch with capacity = its words and cost = epoch; pattern -> each of its
    sources; source -> end with capacity = target. Successive shortest paths."""
    nodes = {"start": 0, "end": 1}
    graph: list[list[list]] = [[], []]

    def node(key):
        if key not in nodes:
            nodes[key] = len(nodes)
            graph.append([])
        return nodes[key]

    def arc(a, b, capacity, cost):
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    given, rest, want = {}, dict(patterns), dict(targets)
    ends = {s for p in rest for s in p}
    for i, (pattern, size) in enumerate(rest.items()):
        for epoch in range(repeats):
            arc(0, node(("p", pattern)), size, epoch)
        for s in pattern:
            arc(node(("p", pattern)), node(("s", s)), repeats * size, 0)
    for s in ends:
        arc(node(("s", s)), 1, want[s], 0)
    potential = [0] * len(graph)
    while True:
        dist: list[float] = [math.inf] * len(graph)
        dist[0], heap, came = 0, [(0, 0)], {}
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for i, (b, capacity, cost, _) in enumerate(graph[a]):
                if capacity and (nd := d + cost + potential[a] - potential[b]) < dist[b]:
                    dist[b], came[b] = nd, (a, i)
                    heapq.heappush(heap, (nd, b))
        if dist[1] == math.inf:
            break
        potential = [p + (d if d < math.inf else 0) for p, d in zip(potential, dist)]
        path, b = [], 1
        while b:
            a, i = came[b]
            path.append((a, i))
            b = a
        flow = min(graph[a][i][1] for a, i in path)
        for a, i in path:
            graph[a][i][1] -= flow
            graph[graph[a][i][0]][graph[a][i][3]][1] += flow
    for pattern, size in rest.items():
        given[pattern] = sum(repeats * size - capacity
                             for b, capacity, _, _ in graph[nodes[("p", pattern)]]
                             if b != 0 and b in {nodes[("s", s)] for s in pattern})
    return given


def _route_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """(_pattern, given) of one connected set of patterns: rows (_pattern, members, wants, n, repeats)."""
    members = [tuple(None if s is None else s for s in x) for x in pdf["_members"]]
    targets = {s: math.floor(t) for p, w in zip(members, pdf["wants"]) for s, t in zip(p, w)}
    given = route(dict(zip(members, map(int, pdf["n"]))), targets, int(pdf["repeats"].iloc[0]))
    return pd.DataFrame({"_pattern": pdf["_pattern"], "given": [given[p] for p in members]})


def _flows(patterns: DataFrame, targets: DataFrame, repeats: int) -> DataFrame:
    """(_pattern, n, given): the words that each pattern gives."""
    held = patterns.select("_pattern", "n", "_members", F.explode("_members").alias("_s"))
    held = held.join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("source", "source_size")
    one = (F.size("_members") == 1) & (F.col("n_patterns") == 1)
    alone = held.filter(one).select("_pattern", F.least(F.floor("target"), F.lit(repeats) * F.col("n")).alias("given"))
    shared = cut_lineage(held.filter(~one), "overlapping")
    if not shared.isEmpty():
        edges = shared.select(F.xxhash64(F.lit("pattern"), "_pattern").alias("a"), F.xxhash64(F.lit("source"), "_s").alias("b"))
        label = components(edges)
        wants = shared.groupBy("_pattern", "n").agg(F.collect_list(F.struct("_s", "target")).alias("w")).select(
            "_pattern", "n", F.transform("w", lambda x: x["_s"]).alias("_members"),
            F.transform("w", lambda x: x["target"]).alias("wants"), F.lit(repeats).alias("repeats"),
            F.xxhash64(F.lit("pattern"), "_pattern").alias("node"))
        routed = wants.join(label, "node").drop("node").groupBy("label").applyInPandas(
            _route_groups, "_pattern string, given long")
        alone = alone.unionByName(routed)
    return patterns.select("_pattern", "n").join(alone, "_pattern", "left").select(
        "_pattern", "n", F.coalesce("given", F.lit(0)).cast("long").alias("given"))


def mix(docs: DataFrame, sources: str, size: str, share: float = SHARE,
        weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED,
        key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(``docs`` (written, small columns only) with ``taken`` (words the mix takes of this row), table (source,
    source_size, n_patterns, target)).

    ``sources``: array column, the sources of the document, null allowed as a
    source; an empty array belongs to none and is never taken. Sources in code
    point order, null last, get the weights in turn. Rows that agree in key, size
    and pattern are taken alike. An empty table gives an empty result.
    """
    members = F.array_sort(F.array_distinct(F.col(sources)))     # null last
    docs = docs.withColumn("_members", members).withColumn(
        "_pattern", F.to_json(F.struct(F.col("_members").alias("s")), {"ignoreNullFields": "false"}))
    patterns = cut_lineage(docs.groupBy("_pattern", "_members").agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n")), "patterns")
    sizes = patterns.select("n", F.explode("_members").alias("source")).groupBy("source").agg(
        F.sum("n").alias("source_size"), F.count("*").alias("n_patterns"))
    total = share * (patterns.agg(F.sum("n")).first()[0] or 0)
    targets = source_targets(sizes, total, weights, repeats)
    docs = docs.drop("_members")

    # whole epochs, and the words left for the seeded selection
    whole = F.least(F.expr("given div n"), F.lit(repeats))
    plan = _flows(patterns, targets, repeats).select(
        "_pattern", F.when(F.col("n") > 0, whole).otherwise(0).alias("_whole"),
        F.when((F.col("n") > 0) & (F.expr("given div n") < repeats), F.expr("given % n")).otherwise(0).alias("_left"),
        F.lit(0).cast("long").alias("_below"))
    plan = cut_lineage(plan, "plan")
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col(size)),
                                  64 - BITS * LEVELS)
    docs = docs.withColumn("_h", spread)
    upto = Window.partitionBy("_pattern").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)    # 1,024 bins
    for level in range(LEVELS):
        step = 1 << (BITS * (LEVELS - 1 - level))
        inside = docs.join(plan.filter("_left > 0"), "_pattern").filter(
            (F.col("_h") >= F.col("_below")) & (F.col("_h") < F.col("_below") + step * (1 << BITS)))
        bins = inside.groupBy("_pattern", "_left", F.expr(f"(_h - _below) div {step}").alias("_b")).agg(F.sum(size).alias("_n"))
        hit = (bins.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
               .filter("_before <= _left AND _before + _n > _left").select("_pattern", "_b", "_before"))
        plan = plan.join(hit, "_pattern", "left").select(
            "_pattern", "_whole", (F.col("_left") - F.coalesce("_before", F.lit(0))).alias("_left"),
            (F.col("_below") + F.coalesce(F.col("_b") * step, F.lit(0))).alias("_below"))
        plan = cut_lineage(plan, "plan")
    tied = (docs.join(plan, "_pattern").filter("_h = _below AND _left > 0").groupBy("_pattern")
            .agg(F.sum(size).alias("_tied")))
    last = cut_lineage(plan.join(tied, "_pattern", "left"), "plan")
    extra = (F.when(F.col("_h") < F.col("_below"), F.col(size))     # _below 0: none
             .when((F.col("_h") == F.col("_below")) & (F.col("_tied") > 0),
                   F.floor(F.col(size) * F.col("_left") / F.col("_tied")))
             .otherwise(0))
    return (docs.join(last, "_pattern")
            .withColumn("taken", (F.col("_whole") * F.col(size) + extra).cast("long"))
            .drop("_h", "_whole", "_left", "_below", "_tied", "_pattern")), targets


def mixed(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id",
          **options) -> DataFrame:
    """(key, size, source_size, target, taken) of each document of ``docs``, one source each.

    Null texts have size 0, null ids and sources are legal (null is a source of
    its own, weighed last), repeated rows are taken alike.
    """
    small = cut_lineage(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"),
                                    word_count(F.col(text)).alias("size")), "mixing")
    out, targets = mix(small.withColumn("_sources", F.array("source")), "_sources", "size", **options)
    known = targets.select(F.col("source").alias("_s"), "source_size", "target")
    return (out.join(known, F.col("source").eqNullSafe(F.col("_s")))
            .select("doc_id", "size", "source_size", "target", "taken", "source"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it."""
    return mixed(table(spark, sf_dir, "documents"))
