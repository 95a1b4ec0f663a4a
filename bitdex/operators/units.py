"""Body selection: lead text for short articles, title-guided extraction for
long ones (C1 and its parts G1, J1, W1, W2, T2, R3, P1-P11).

``build_bodies`` keeps every article in its own row: the units, their
vectors, scores, ranking and budget are arrays of that row, so the whole
selection is one narrow stage with **no shuffle** (a document is already
one row; nothing is regrouped). The table forms below (``extraction_
worklist``, ``score_units``, ``rank_units``, ``budget_units``,
``restore_order``) express the same steps over exploded ``(id, pos)`` rows,
for unit vectors that come from a separate job; they shuffle on ``id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..session import cut_lineage
from . import encode as enc


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# -- in-row selection ---------------------------------------------------------

def ranked_units(units: Column, scores: Column) -> Column:
    """Units as structs ``(neg_score, pos, cost, unit)`` sorted by score
    descending, then position ascending (W1; ties take the lower position)."""
    items = F.transform(
        units, lambda u, i: F.struct(
            (-F.element_at(scores, i + 1)).alias("neg_score"),
            i.alias("pos"),
            (F.length(u) + 1).alias("cost"),
            u.alias("unit")))
    return F.array_sort(items)


def budget_count(ranked: Column, cap: int) -> Column:
    """How many ranked units are taken: always the first, then each while the
    running cost stays within ``cap``; the first that does not fit stops the
    walk (W2)."""
    init = F.struct(F.lit(0).cast("bigint").alias("total"),
                    F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["n"] == 0) | (acc["total"] + x["cost"] <= cap)
        return F.when(acc["stop"], acc).when(
            fits, F.struct((acc["total"] + x["cost"]).alias("total"),
                           (acc["n"] + 1).alias("n"), F.lit(False).alias("stop"))
        ).otherwise(F.struct(acc["total"].alias("total"), acc["n"].alias("n"),
                             F.lit(True).alias("stop")))

    return F.aggregate(ranked, init, step)["n"]


def select_units(units: Column, scores: Column, cap: int) -> Column:
    """Chosen units back in document order, joined by one space, capped on a
    sentence boundary (W1 + W2 + T2)."""
    def pick(ranked: Column) -> Column:
        chosen = F.slice(ranked, 1, budget_count(ranked, cap))
        in_order = F.array_sort(F.transform(
            chosen, lambda x: F.struct(x["pos"].alias("pos"), x["unit"].alias("unit"))))
        return tx.sentence_cap(
            F.array_join(F.transform(in_order, lambda x: x["unit"]), " "), cap)
    return vx.let(scores, lambda sc: vx.let(ranked_units(units, sc), pick))


def unit_scores(uvecs: Column, tvec: Column) -> Column:
    """Cosine of each unit vector with the title vector (J1 + V1 + V3; the
    vectors are unit length)."""
    return F.transform(uvecs, lambda u: vx.dot(u, tvec))


def route_columns(corpus: DataFrame, long: int = tx.DEFAULT_LONG) -> DataFrame:
    """Add ``units`` (long texts only) and ``extractive``."""
    return (corpus
            .filter(tx.non_empty("text"))                                    # P1
            .withColumn("units", F.when(tx.is_long("text", long),
                                        tx.split_units("text")))
            .withColumn("extractive",
                        F.coalesce(tx.is_extractive("text", "units", long),
                                   F.lit(False))))


def build_bodies(corpus: DataFrame, cap: int = tx.DEFAULT_CAP,
                 long: int = tx.DEFAULT_LONG, encoder=None, mode: str = "auto",
                 min_partitions: int | None = None,
                 keep_route: bool = False) -> DataFrame:
    """(id, title, body) for every article with a non-empty body.

    Short and medium articles take ``lead``; long articles with at least four
    units take the title-guided extraction. Only extractive rows send their
    title and units to the encoder (one Arrow pass that returns the unit
    scores); the other rows pass nulls.
    """
    encoder = encoder or enc.HashPoolEncoder()
    routed = route_columns(
        enc.spread(corpus.filter(tx.non_empty("text") & tx.has_content("text")),  # P1, P10
                   min_partitions), long)
    # units are made once: projections above would be merged with theirs, and make them for each use
    routed = vx.settle(routed, "id", "title", "text", "units", "extractive")
    ext = F.col("extractive")
    scored = routed.withColumn("_scores", enc.score_col(
        F.when(ext, tx.title_query("title")), F.when(ext, F.col("units")), encoder, mode))
    body = F.when(ext, select_units(F.col("units"), F.col("_scores"), cap)
                  ).otherwise(tx.lead("text", cap))
    cols = [F.col("id"), tx.clean_title("title").alias("title"), body.alias("body")]
    if keep_route:
        cols.append(ext.alias("extractive"))
    return vx.settle(scored, *cols)


# -- table forms ----------------------------------------------------------------

def extraction_worklist(corpus: DataFrame, long: int = tx.DEFAULT_LONG) -> DataFrame:
    """(id, pos, line): per extractive article its title query at ``pos = -1``
    and every unit at ``pos = 0, 1, ...`` (G1), from one scan."""
    routed = route_columns(corpus.filter(tx.is_long("text", long)), long).filter("extractive")
    return routed.select("id", F.posexplode(F.concat(F.array(tx.title_query("title")), "units"))
                         .alias("pos", "line")).withColumn("pos", F.col("pos") - 1)


def worklist_vectors(corpus: DataFrame, encoder, long: int = tx.DEFAULT_LONG) -> DataFrame:
    """(id, pos, line, vec): the worklist encoded once and written, for the steps below."""
    return cut_lineage(enc.embed(enc.spread(extraction_worklist(corpus, long)), "line", "vec", encoder),
                       "worklist")


def score_units(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """(id, pos, unit, score): each unit row (pos >= 0) joined on ``id`` to its
    title row (pos = -1) and scored by the dot product (J1). ``vectors`` is a written
    table (``worklist_vectors``)."""
    t = vectors.filter(F.col("pos") == -1).select("id", F.col(vec).alias("_t"))
    u = vectors.filter(F.col("pos") >= 0)
    return u.join(t, "id").select("id", "pos", F.col("line").alias("unit"),
                                  vx.dot(vec, "_t").alias("score"))


def rank_units(scored: DataFrame) -> DataFrame:
    """Add ``rank``: score descending, position ascending, per id."""
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("pos"))
    return scored.withColumn("rank", F.row_number().over(w))


def budget_units(ranked: DataFrame, cap: int = tx.DEFAULT_CAP,
                 unit: str = "unit") -> DataFrame:
    """Keep rank 1 and every unit whose running cost ``len + 1`` in rank
    order stays within ``cap`` (W2). Costs are positive, so the running sum
    is monotone and this filter equals stopping at the first misfit."""
    w = (Window.partitionBy("id").orderBy("rank")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = F.sum(F.length(unit) + 1).over(w)
    return (ranked.withColumn("running", running)
            .filter((F.col("rank") == 1) | (F.col("running") <= cap))
            .drop("running"))


def chosen_units(scored: DataFrame, cap: int = tx.DEFAULT_CAP, unit: str = "unit") -> DataFrame:
    """The units of ``scored`` that W1 and W2 choose, for articles of any number of units. A unit costs 2
    at least (one character and one more), so none past rank ``cap // 2 + 1`` fits: each task sends only its
    best that many of an article (a group limit below the shuffle, up to ranks of
    ``spark.sql.optimizer.windowGroupLimitThreshold``), and the running sum stops there."""
    cost = F.length(unit) >= 1
    ranked = rank_units(scored.filter(cost)).filter(F.col("rank") <= cap // 2 + 1)
    return budget_units(ranked, cap, unit)


def restore_order(chosen: DataFrame, cap: int = tx.DEFAULT_CAP,
                  unit: str = "unit") -> DataFrame:
    """(id, body): chosen units in document order joined by a space, then
    the sentence cap (T2). The group is one article's chosen units, bounded
    by the budget."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col(unit).alias("u"))))
    return chosen.groupBy("id").agg(
        tx.sentence_cap(F.array_join(F.transform(ordered, lambda x: x["u"]), " "),
                        cap).alias("body"))
