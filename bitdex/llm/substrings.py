"""Substring dedup by de Bruijn compaction.

The graph: an edge is a k-mer of ``k`` consecutive words (its nodes are the two
(k-1)-mers). A repeated edge marks its k words. Storing 1 row for each edge
would cost a row per word, so edges travel compacted, as in minimizer-based
de Bruijn compaction: all consecutive edges of a text that share the same
minimizer occurrence (the smallest of the ``m``-mer hashes inside the edge) form
one *path piece*, about 1 row for 14 words.

1. every text is cut into pieces: (minimizer hash, piece hash, first word, end);
   equal edges always have the same minimizer at the same offset, so two equal
   edges lie in pieces of the same minimizer hash;
2. one count per minimizer drops those that occur once: nothing in them repeats;
3. if all pieces of a minimizer are equal, the whole piece repeats: a nonbranching
   path, which needs no look at its edges;
4. where pieces of a minimizer differ (the path branches or ends inside), the
   edges of one occurrence of each different piece are counted, weighted by how
   often that piece occurs;
5. repeated pieces and edges are joined back to their source coordinates, glued
   there into maximal repeated spans, and cut out of the text.

Edges are told apart by a 64-bit minimizer hash and a 64-bit edge hash together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches, row_key, table
from .words import Powers, mix, prefix_sums, span_hashes, window_hashes, word_hashes

K = 35          # words of an edge: shorter repeats stay
M = 8           # words of a minimizer


POSITION = np.uint64(28)     # low bits that hold a position while minima are taken


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive elements, from minima that run forwards and
    backwards in blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, ~np.uint64(0))
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def _pieces(w: np.ndarray, offsets: np.ndarray, k: int, m: int, powers: Powers):
    """(row, minimizer hash, piece hash, first word, end) of each piece of some texts."""
    p = prefix_sums(w, powers)
    mers = window_hashes(p, m, powers)
    # leftmost minimum: the position is the low end of what is compared
    packed = (mers >> POSITION << POSITION) | np.arange(len(mers), dtype=np.uint64)
    at = (_window_minima(packed, k - m + 1) & ((np.uint64(1) << POSITION) - np.uint64(1))).astype(np.int64)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
    edge = np.concatenate([np.arange(a, b - k + 1) for a, b in zip(offsets[:-1], offsets[1:]) if b - a >= k])
    at = at[edge]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    mini, row = at[first], row[first]
    first, end = edge[first], edge[last] + k
    piece = mix(span_hashes(p, first, end, powers)
                ^ ((mini - first).astype(np.uint64) << np.uint64(32))
                ^ (end - first).astype(np.uint64))
    return row, mix(mers[mini]), piece, first - offsets[row], end - offsets[row]


def _emit_pieces(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for start, w, offsets in word_hashes(batch.column(1)):
                if np.diff(offsets).max() >= k:
                    row, mini, piece, first, end = _pieces(w, offsets, k, m, powers)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mini.view(np.int64)), pa.array(piece.view(np.int64)),
                         pa.array(keys[start + row]), pa.array(first.astype(np.int32)),
                         pa.array(end.astype(np.int32))],
                        names=["mini", "piece", "rk", "first", "end"])
    return run


def _emit_edges(k: int):
    """Edges of the pieces to check: (mini, edge, rk, at, n), n: how often the piece occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for start, w, offsets in word_hashes(batch.column(1)):
                edges = window_hashes(prefix_sums(w, powers), k, powers)
                todo = batch.column(2).slice(start, len(offsets) - 1).to_pylist()
                out = []
                for i, pieces in enumerate(todo):
                    for x in pieces:
                        at = np.arange(x["first"], x["end"] - k + 1)
                        out.append((np.full(len(at), x["mini"], np.int64),
                                    edges[offsets[i] + at].view(np.int64),
                                    np.full(len(at), keys[start + i], np.int64), at.astype(np.int32),
                                    np.full(len(at), x["n"], np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in zip(*out)],
                        names=["mini", "edge", "rk", "at", "n"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the covered words out of each text."""
    for batch in batches:
        n_words, n_removed, n_spans, sha, kept = [], [], [], [], []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()):
            words = (text or b"").split()
            cover = np.zeros(len(words) + 1, np.int64)
            for x in spans or ():
                cover[x["first"]] += 1
                cover[x["end"]] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            removed = int(gone.sum())
            left = b" ".join([w for w, g in zip(words, gone) if not g] if removed else words)
            n_words.append(len(words))
            n_removed.append(removed)
            n_spans.append(int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left if removed else text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(batch.num_columns - 2)]
            + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
               pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()),
               pa.array(kept, pa.binary())],
            names=batch.schema.names[:-2]
            + ["_n_words", "_n_removed", "_n_spans", "_sha", "_kept"])


def repeated_spans(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """Repeated spans of texts: (rk, first, end), words ``first`` to ``end - 1``
    of the row whose key is ``rk``. ``docs``: (rk, text as bytes)."""
    pieces = docs.transform(map_batches, _emit_pieces(k, m),
                             "mini long, piece long, rk long, first int, end int")
    # written, so that the join below reads both sides anew and a hot minimizer can be split
    minis = cut_lineage(
        pieces.groupBy("mini")
        .agg(F.count("*").alias("_n"), F.min("piece").alias("_lo"), F.max("piece").alias("_hi"))
        .filter("_n >= 2")
        .select("mini", (F.col("_lo") == F.col("_hi")).alias("whole")), "minimizers")
    found = cut_lineage(pieces.join(minis, "mini"), "pieces")
    whole = found.filter("whole").select("rk", "first", "end")

    # Branching minimizers: how often each different piece occurs, and one of its occurrences.
    mixed = found.filter(~F.col("whole")).withColumn("_at", F.struct("rk", "first"))
    kinds = cut_lineage(
        mixed.groupBy("mini", "piece").agg(F.count("*").alias("n"), F.min("_at").alias("_one")), "kinds")
    mixed = mixed.join(kinds, ["mini", "piece"])
    again = mixed.filter("n >= 2").select("rk", "first", "end")
    check = (mixed.filter((F.col("n") == 1) | (F.col("_at") == F.col("_one")))
             .groupBy("rk").agg(F.collect_set(F.struct("first", "end", "mini", "n")).alias("_todo")))
    edges = (docs.join(check, "rk").select("rk", "text", "_todo")
             .transform(map_batches, _emit_edges(k), "mini long, edge long, rk long, at int, n long"))
    often = edges.groupBy("mini", "edge").agg(F.sum("n").alias("_n")).filter("_n >= 2")
    parts = (edges.filter("n = 1").join(often.select("mini", "edge"), ["mini", "edge"], "left_semi")
             .select("rk", F.col("at").alias("first"), (F.col("at") + k).alias("end")))
    return whole.unionByName(again).unionByName(parts)


def cut_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id",
                k: int = K, m: int = M) -> DataFrame:
    """``docs`` with ``_n_words, _n_removed, _n_spans, _sha, _kept`` added: each word
    covered by a k-word window that also starts anywhere else is removed.

    ``_kept`` is the kept words joined by one space if any went, else the text as
    it was. Null or empty texts have no words and keep their text. Texts under k
    words lose nothing. A repeated row (same id and text) counts as an occurrence
    of its own, so all its windows repeat. Null ids are legal. Other columns pass
    through unchanged.
    """
    names = docs.columns
    keyed = docs.select(row_key(id, text).alias("_rk"),
                        F.col(text).cast("binary").alias("_text"),
                        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text])
    texts = keyed.filter("_text IS NOT NULL").select(F.col("_rk").alias("rk"),
                                                    F.col("_text").alias("text"))
    spans = (repeated_spans(texts, k, m).groupBy(F.col("rk").alias("_rk"))
             .agg(F.collect_set(F.struct("first", "end")).alias("_spans")))
    others = [(f"c{i}", c) for i, c in enumerate(names) if c != text]
    joined = keyed.join(spans, "_rk", "left").select(*[a for a, _ in others], "_text", "_spans")
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{a} {kinds[c]}" for a, c in others]
                       + ["_n_words long", "_n_removed long", "_n_spans long", "_sha string",
                          "_kept binary"])
    out = joined.transform(map_batches, _cut, schema)
    back = {c: F.col(a).alias(c) for a, c in others} | {text: F.col("_kept").cast("string").alias(text)}
    return out.select(*[back[c] for c in names],
                      *["_n_words", "_n_removed", "_n_spans", "_sha"])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: words, removed words, digest of the kept words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_repeats(docs).select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
        F.col("_sha").alias("kept_sha256"), F.col("_n_spans").alias("n_spans"))
