"""Phrase collocations by dynamic itemset counting.

The corpus is written once in ``shards`` parts, which are scanned in turn, over and over. A scan
counts phrases of all lengths side by side: words from the start; a longer phrase becomes
active at the step after both its subphrases (without the last word, without the first)
reached the threshold, and is counted for one full cycle of the shards from there. So its
count is exact, and phrases of length 3 start while those of length 2 are still counted,
instead of one pass of the corpus for each length.

Which phrases reached the threshold, and at which step, travels to the scans as a filter of a
fixed size for each length (``slots`` steps of one byte, two for each phrase, at the places its
hash names). The filter never misses a phrase; one that it takes in by mistake is counted
over a full cycle as well, so it costs work and changes no result. No set of phrases, whose size
grows with the corpus, is broadcast or collected.

A task counts the phrases of a run of texts at a time (about ``CHUNK`` bytes of whole pieces), so a
phrase that fills the corpus is one row for each run. Rows name a phrase by the 64-bit hashes of its words (with
the language); words themselves travel once, and phrases get theirs by joins at the end.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import BROADCAST_KEYS, cut_by, free_shuffles, map_batches, table
from .words import MULT, _LOWER, _hash_words, mix

THRESHOLD = 10               # occurrences from which a phrase counts
LONGEST = 3                  # words of a phrase
TOP = 2000                   # phrases of a language in the report
SHARDS = 3                   # parts of the corpus that are scanned in turn
SLOTS = 1 << 24              # of a length's filter; a power of 2
CHUNK = 4 << 20              # bytes counted together (or one piece)
NEVER = 255                  # in a filter: not reached

_BREAK = np.zeros(256, bool)                  # ends a piece
_BREAK[[ord(c) for c in ".,;:!?"]] = True
_BREAK[0x0A:0x0E] = True
_APART = _BREAK.copy()                        # ends a word
_APART[[0x20, 0x09]] = True


def _runs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, where texts or their parts start, their rows) of runs of about CHUNK bytes; a longer text is
    cut where a piece ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, rows = [], []
    for row in np.flatnonzero(np.diff(offsets) > CHUNK):
        at = offsets[row] + CHUNK
        while at < offsets[row + 1]:
            for lo in range(at, offsets[row + 1], CHUNK):
                found = np.flatnonzero(_BREAK[data[lo:min(lo + CHUNK, offsets[row + 1])]])
                if len(found):
                    starts.append(lo + found[0])
                    rows.append(row)
                    break
            else:
                break
            at = starts[-1] + CHUNK
    starts = np.concatenate([offsets[:-1], np.array(starts, np.int64)])
    rows = np.concatenate([np.arange(len(texts)), np.array(rows, np.int64)])
    order = np.argsort(starts, kind="stable")
    starts, rows = starts[order], rows[order]
    ends = np.append(starts[1:], offsets[-1])
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        yield data[starts[i]:ends[j - 1]], starts[i:j] - starts[i], rows[i:j]
        i = j


def _words(data: np.ndarray, starts: np.ndarray):
    """Lower-cased bytes (8 spare ones at the end), first byte, length and part of each word, and whether
    the next word goes on in the same piece."""
    low = np.zeros(len(data) + 8, np.uint8)
    low[:-8] = _LOWER[data]
    apart = _APART[low[:-8]]
    begins = ~apart
    begins[1:] &= apart[:-1]
    ends = ~apart
    ends[:-1] &= apart[1:]
    heads = starts[starts < len(data)]
    begins[heads] = ~apart[heads]
    tails = heads[heads > 0] - 1
    ends[tails] = ~apart[tails]
    first = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - first
    breaks = np.cumsum(_BREAK[low[:-8]], dtype=np.int32)[first]
    part = np.searchsorted(starts, first, "right") - 1
    on = np.zeros(len(first), bool)
    on[:-1] = (breaks[1:] == breaks[:-1]) & (part[1:] == part[:-1])
    return low, first, length, part, on


def _extend(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word."""
    return mix(hashes * MULT + word)


def _slots(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(slots - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _when(steps: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The step at which each phrase had reached the threshold."""
    a, b = _slots(hashes, len(steps))
    return np.maximum(steps[a], steps[b])


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place, occurrences) of each different hash."""
    order = np.argsort(hashes)
    new = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
    return order[new], np.diff(np.append(new, len(order)))


def _keys(longest: int) -> list[str]:
    return [f"k{i + 1}" for i in range(longest)]


def _schema(longest: int) -> str:
    return "m int, " + ", ".join(f"{k} long" for k in _keys(longest)) + ", lang string, word string, n long"


def _strings(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> pa.Array:
    end = np.cumsum(length)
    at = np.arange(end[-1] if len(end) else 0) + np.repeat(first - (end - length), length)
    offsets = np.concatenate([[0], end]).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def _count(shared, step: int, shards: int, longest: int):
    """(``_schema``): the phrases that are active at this step, with their number in each run of texts."""
    def active(since: np.ndarray) -> np.ndarray:
        since = since.astype(np.int16)
        return (since < step) & (step <= since + shards) & (since != NEVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        names = [f.split(" ")[0] for f in _schema(longest).split(", ")]

        def rows(m: int, at: np.ndarray, n: np.ndarray, key: np.ndarray, lang: pa.Array, word: pa.Array):
            cols = [pa.array(key[at + i].view(np.int64)) if i < m else pa.nulls(len(at), pa.int64())
                    for i in range(longest)]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), m, np.int32)), *cols, lang, word, pa.array(n.astype(np.int64))], names=names)

        for batch in batches:
            langs = pc.dictionary_encode(batch.column(0))
            salt = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs.dictionary.to_pylist()], np.uint64)
            code = langs.indices.to_numpy()
            for data, starts, row in _runs(batch.column(1)):
                low, first, length, part, on = _words(data, starts)
                if not len(first):
                    continue
                lang = code[row[part]]
                key = mix(_hash_words(low, first, length) ^ salt[lang])
                if step <= shards:
                    at, n = _distinct(key)
                    yield rows(1, at, n, key, langs.dictionary.take(pa.array(lang[at])).cast(pa.string()),
                               _strings(low, first[at], length[at]))
                hashes, since = key, _when(filters[0], key)
                at = np.flatnonzero(on)                       # where phrases of m words start
                for m in range(2, longest + 1):
                    both = np.maximum(since[at], since[at + 1])
                    grown = np.zeros(len(key), np.uint64)
                    grown[at] = _extend(hashes[at], key[at + m - 1])
                    now = at[active(both)]
                    if len(now):
                        one, n = _distinct(grown[now])
                        none = pa.nulls(len(one), pa.string())
                        yield rows(m, now[one], n, key, none, none)
                    if m < longest:
                        since = np.full(len(key), NEVER, np.uint8)
                        since[at] = np.where(both == NEVER, NEVER, _when(filters[m - 1], grown[at]))
                        hashes, at = grown, at[on[at + m - 1]]
    return run


def _marks(slots: int, m: int):
    """(w, b): word and bit of the filter's places of each phrase."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            hashes = functools.reduce(_extend, keys)
            at = np.concatenate(_slots(hashes, slots))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> 6).astype(np.int32)), pa.array(np.int64(1) << (at & 63))], names=["w", "b"])
    return run


def _reach(frequent: DataFrame, m: int, steps: np.ndarray, step: int) -> bool:
    """Enter the phrases of ``frequent`` that ``steps`` doesn't hold; whether there were any. The driver gets
    one row for each 64 slots at most."""
    bits = (frequent.select(*_keys(m)).transform(map_batches, _marks(len(steps), m), "w int, b long")
            .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    if not bits.num_rows:
        return False
    b = np.ascontiguousarray(bits["b"].to_numpy())
    row, bit = np.nonzero(np.unpackbits(b.view(np.uint8).reshape(len(b), 8), axis=1, bitorder="little"))
    at = bits["w"].to_numpy()[row].astype(np.int64) * 64 + bit
    new = at[steps[at] == NEVER]
    steps[new] = step
    return len(new) > 0


def count_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", threshold: int = THRESHOLD,
                  longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS
                  ) -> tuple[dict[int, DataFrame], DataFrame]:
    """({m: (k1.., n) of every phrase of m words that occurs ``threshold`` times in a language}, (lang, n)
    of all words). Table 1 has ``lang`` and ``word`` too; equal keys are equal words of a language."""
    if longest < 2 or shards < 1 or shards * (longest + 1) >= NEVER:
        raise ValueError("longest must be 2 or more, and its shards' steps below 255")
    spark = docs.sparkSession
    texts = cut_by(docs.filter(F.length(text) > 0).select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"),
        F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard")), "shards", "shard")
    schema, keys = _schema(longest), _keys(longest)
    filters = [np.full(slots, NEVER, np.uint8) for _ in range(longest - 1)]
    last = {1: shards}                        # the last step at which a phrase of a length is active
    parts: dict[int, list[DataFrame]] = {m: [] for m in range(1, longest + 1)}
    frequent: dict[int, DataFrame] = {}

    def total(m: int) -> DataFrame:
        by = keys[:m] + (["lang", "word"] if m == 1 else [])
        rows = functools.reduce(DataFrame.unionByName, parts[m])
        if len(parts[m]) > 1:
            rows = rows.groupBy(*by).agg(F.sum("n").alias("n"))
        return rows.filter(F.col("n") >= threshold).select(*by, "n")

    step = 0
    while step < max(last.values()):
        step += 1
        shared = spark.sparkContext.broadcast(filters)
        found = (texts.filter(F.col("shard") == (step - 1) % shards).select("lang", "text")
                 .transform(map_batches, _count(shared, step, shards, longest), schema)
                 .groupBy("m", *keys, "lang", "word").agg(F.sum("n").alias("n")))
        found = cut_by(found, f"counts-{step}", "m")
        shared.destroy()
        free_shuffles(spark)
        for m in [m for m in sorted(last) if step <= last[m]]:
            parts[m].append(found.filter(F.col("m") == m))
            # A length's counts are added up after each step of its first cycle and at its end; between,
            # few phrases are left, and those that reach the threshold start later, but whole.
            if m < longest and (len(parts[m]) <= shards or step == last[m]):
                frequent[m] = cut_lineage(total(m), f"frequent-{m}")
                if _reach(frequent[m], m, filters[m - 1], step):
                    last[m + 1] = step + shards
    for m in range(1, longest + 1):
        if m not in frequent:
            frequent[m] = cut_lineage(total(m), f"frequent-{m}") if parts[m] else spark.createDataFrame(
                [], ", ".join(f"{k} long" for k in keys[:m]) + ", n long")
    words = functools.reduce(DataFrame.unionByName, parts[1]).groupBy("lang").agg(F.sum("n").alias("n"))
    return frequent, words


def _score(a: str, l: str, r: str) -> Column:
    """floor(1000000 * a * a / (l * r)) in decimals: exact up to counts of 10**16."""
    whole = [f"cast({x} as decimal(19, 0))" for x in (a, l, r)]
    return F.expr(f"cast(({whole[0]} * {whole[0]} * 1000000) div ({whole[1]} * {whole[2]}) as bigint)")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", threshold: int = THRESHOLD,
                 longest: int = LONGEST, top: int = TOP, cover: int = 50, shards: int = SHARDS,
                 slots: int = SLOTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score, a
    (both falling) and phrase.

    Texts have A-Z lower-cased and are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those at spaces and tabs into
    words. A candidate is a phrase of 2 to ``longest`` words that occurs ``threshold`` times (a) in the
    language; its lowest-scoring cut into two parts of l and r occurrences counts. Candidates
    inside a longer one that occurs in ``cover`` of 100 of their places are left out: it is enough to look one word
    further, as a phrase between the two is at least as frequent as the longer one.

    A null language counts as 'und'. Null and empty texts hold nothing, repeated rows count each, other
    columns play no part, an empty table gives no rows."""
    frequent, totals = count_phrases(docs, lang, text, threshold, longest, shards, slots)
    keys = _keys(longest)
    found = []
    for m in range(2, longest + 1):
        c = frequent[m].withColumnRenamed("n", "a")
        cuts = []
        for k in range(1, m):
            left = frequent[k].select(*keys[:k], F.col("n").alias(f"l{k}"))
            right = frequent[m - k].select(*[F.col(x).alias(y) for x, y in zip(keys, keys[k:m])],
                                           F.col("n").alias(f"r{k}"))
            c = c.join(left, keys[:k]).join(right, keys[k:m])
            cuts.append(F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"),
                                 F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        c = c.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
        if m < longest:
            longer = frequent[m + 1]
            inside = longer.select(*keys[:m], "n").unionByName(
                longer.select(*[F.col(x).alias(y) for x, y in zip(keys[1:m + 1], keys)], "n"))
            inside = inside.groupBy(*keys[:m]).agg(F.max("n").alias("_most"))
            c = c.join(inside, keys[:m], "left").filter(
                f"_most IS NULL OR 100 * cast(_most as decimal(19, 0)) < {int(cover)} * cast(a as decimal(19, 0))")
        found.append(c.select(*keys[:m], *[F.lit(None).cast("long").alias(k) for k in keys[m:]], "a", "cut.*"))
    words = frequent[1]
    scored = cut_lineage(functools.reduce(DataFrame.unionByName, found).join(
        words.select("k1", "lang", F.col("word").alias("w1")), "k1"), "scored")

    # What can't be among the first goes before phrases get their words; ties at the end stay.
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    last = (scored.select("lang", "score", "a").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top)
            .groupBy("lang").agg(F.min(F.struct("score", "a")).alias("_last")))
    last = cut_lineage(last, "last")
    if last.count() <= BROADCAST_KEYS:        # one row for each language; else both sides are dealt by it
        last = F.broadcast(last)
    named = scored.join(last, "lang").filter(F.struct("score", "a") >= F.col("_last"))
    for i, k in enumerate(keys[1:], 2):
        named = named.join(words.select(F.col("k1").alias(k), F.col("word").alias(f"w{i}")), k, "left")
    named = named.withColumn("phrase", F.concat_ws(" ", *[f"w{i + 1}" for i in range(longest)]))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.select("lang", "phrase", "a", "l", "r", "score").withColumn("rank", F.row_number().over(w)).filter(
        F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of 2 to 3 words of each language."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
