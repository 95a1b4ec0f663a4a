"""Word-piece segmentation against a vocabulary table.

Semantics: a word is prefixed with U+2581 and segmented greedily from the
front, taking at each position the longest piece found in the vocabulary;
if some position has no piece at all, the **whole word** becomes one
``[UNK]`` id.

Plan: the vocabulary becomes a trie in four arrays, which is broadcast, and the distinct words of an
Arrow batch walk it together, one character a step: no row for a substring. Tokens get their pieces where
they are (a task remembers up to ``KEPT`` words), so token tables, profiles and id lists shuffle no token;
``segment_words`` shuffles the distinct words. The trie's size is checked first (the characters of the vocabulary bound
its nodes); a vocabulary beyond ``TRIE_CHARS`` stays a table, and substrings meet it by a join:

1. every (word, start, length) substring with ``length <= max piece
   length`` -- an exact bound, longer substrings cannot match -- equi-joined
   to the vocabulary;
2. the longest match per (word, start), gathered per word (at most one
   entry per character of that word) and walked with ``aggregate``;
3. words without a whole walk come out as ``[UNK]``.

Profiles add up the tokens of each document in their batch, and a left join from the documents keeps those
without words. By the join, they count the words of each document first, so a word that fills the corpus
joins one row for each document.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import vectors as vx
from ..session import cut_lineage

# The word-initial marker and the default unknown id.
WORD_PREFIX = "▁"
DEFAULT_UNK_ID = 0

TRIE_CHARS = 4_000_000       # characters of a vocabulary that is broadcast: 20 bytes each at most
FEW = 64                     # words that go on one by one
POINT_BITS = 21              # of a code point
KEPT = 100_000               # words whose pieces a task remembers
KEPT_CHARS = 4_000_000       # and their characters at most
PIECES = 1_000_000           # ids of a batch that is passed on


class Trie:
    """A vocabulary as arrays: an edge is a node and a code point, in order; a node may end a piece."""

    def __init__(self, tokens: list[str], ids: np.ndarray):
        points, offsets = code_points(tokens)
        length = np.diff(offsets)
        node = np.zeros(len(tokens), np.int64)                 # of each token so far
        keys, children, n_nodes = [], [], 1
        for at in range(int(length.max(initial=0))):           # all tokens grow by one character
            left = np.flatnonzero(length > at)
            key, child = np.unique(node[left] << POINT_BITS | points[offsets[left] + at], return_inverse=True)
            keys.append(key)
            children.append(n_nodes + np.arange(len(key)))
            node[left] = n_nodes + child
            n_nodes += len(key)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        children = np.concatenate(children) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], children[order].astype(np.int32)
        self.ends = np.zeros(n_nodes, bool)
        self.ids = np.full(n_nodes, np.iinfo(np.int64).min)
        whole = length > 0                                     # an empty piece matches nothing
        self.ends[node[whole]] = True
        np.maximum.at(self.ids, node[whole], ids[whole])       # one piece with two ids: the larger

    def step(self, node: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(child, whether there is one) of each node and code point."""
        if not len(self.keys):
            return node, np.zeros(len(node), bool)
        key = node.astype(np.int64) << POINT_BITS | point
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.children[at], self.keys[at] == key

    def walk(self, words: list[str]) -> list[list[int] | None]:
        """Ids of the pieces of each word, longest first from the front; None where some place has none."""
        points, offsets = code_points(words)
        out: list = [[] for _ in words]
        word = np.arange(len(words))
        at, end = offsets[:-1].copy(), offsets[1:]
        node = np.zeros(len(words), np.int32)
        stop, found = np.full(len(words), -1), np.zeros(len(words), np.int64)    # longest piece so far
        word = word[at < end]
        for i in np.flatnonzero(at == end):
            out[i] = None
        while len(word) > FEW:
            inside = at[word] < end[word]
            child, there = self.step(node[word], points[np.minimum(at[word], len(points) - 1)])
            there &= inside
            on = word[there]
            node[on] = child[there]
            at[on] += 1
            piece = on[self.ends[node[on]]]
            stop[piece], found[piece] = at[piece], self.ids[node[piece]]
            for i in (stuck := word[~there]):
                if stop[i] < 0:
                    out[i] = None
                else:
                    out[i].append(int(found[i]))
            at[stuck], node[stuck] = stop[stuck], 0
            over = stuck[(stop[stuck] < 0) | (stop[stuck] == end[stuck])]
            stop[stuck] = -1
            if len(over):
                word = word[~np.isin(word, over)]
        for i in word:
            out[i] = self._alone(points[offsets[i]:end[i]].tolist(), at[i] - offsets[i], int(node[i]),
                                 int(stop[i] - offsets[i]) if stop[i] >= 0 else -1, int(found[i]), out[i])
        return out

    def _alone(self, points: list[int], at: int, node: int, stop: int, found: int, ids: list) -> list | None:
        """The rest of one word's walk."""
        if not hasattr(self, "edges"):
            self.edges = dict(zip(self.keys.tolist(), self.children.tolist()))
        while True:
            child = self.edges.get(node << POINT_BITS | points[at]) if at < len(points) else None
            if child is not None:
                node, at = child, at + 1
                if self.ends[node]:
                    stop, found = at, int(self.ids[node])
                continue
            if stop < 0:
                return None
            ids.append(found)
            if stop == len(points):
                return ids
            at, node, stop = stop, 0, -1


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each begins (and the last one ends)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def _trie(vocab: DataFrame, trie_chars: int):
    """The vocabulary as a written table, and as a broadcast trie (None beyond ``trie_chars``)."""
    vocab = cut_lineage(vocab.select("token", F.col("token_id").cast("bigint").alias("token_id"))
                        .filter("token IS NOT NULL AND token_id IS NOT NULL"), "vocabulary")
    size = vocab.agg(F.sum(F.length("token"))).first()[0] or 0
    if size > trie_chars:
        return vocab, None
    got = vocab.toArrow()
    return vocab, vocab.sparkSession.sparkContext.broadcast(
        Trie(got["token"].to_pylist(), got["token_id"].to_numpy()))


class Walked:
    """Ids of the pieces of words, None for unknown ones; those met before are remembered, up to a limit."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.clear()

    def clear(self) -> None:
        self.ids, self.chars = {}, 0

    def __call__(self, words: list[str]) -> list[list[int] | None]:
        """The pieces of distinct ``words``."""
        if len(self.ids) > KEPT or self.chars > KEPT_CHARS:
            self.clear()
        new = [w for w in words if w not in self.ids]
        self.ids.update(zip(new, self.trie.walk([WORD_PREFIX + w for w in new])))
        self.chars += sum(map(len, new))
        return [self.ids[w] for w in words]


def segment_words(words: DataFrame, vocab: DataFrame, word: str = "word",
                  unk_id: int = DEFAULT_UNK_ID, trie_chars: int = TRIE_CHARS) -> DataFrame:
    """(word, known, piece_ids) for each distinct word (F8). Null words are unknown."""
    vocab, trie = _trie(vocab, trie_chars)
    if trie is None:
        return _segment_by_join(words, vocab, word, unk_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            ids = trie.value.walk([WORD_PREFIX + t if t is not None else "" for t in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x is not None for x in ids]),
                 pa.array([[unk_id] if x is None else x for x in ids], pa.list_(pa.int64()))],
                names=["word", "known", "piece_ids"])

    distinct = words.select(F.col(word).alias("word")).distinct()
    return distinct.mapInArrow(run, "word string, known boolean, piece_ids array<bigint>")


def _segment_by_join(words: DataFrame, vocab: DataFrame, word: str, unk_id: int) -> DataFrame:
    """``segment_words`` against a vocabulary of any size, a written table."""
    max_len = int(vocab.agg(F.max(F.length("token"))).first()[0] or 0)
    v = vocab.select(F.col("token").alias("piece"), F.col("token_id").cast("bigint").alias("tid"))
    # written once: the substrings and the final left join both read it
    w = (cut_lineage(words.select(F.col(word).alias("word")).distinct(), "words")
         .withColumn("w1", F.concat(F.lit(WORD_PREFIX), F.col("word")))
         .withColumn("n", F.length("w1")))
    subs = (w.select("word", "w1", "n",
                     F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
            .select("word", "w1", "n", "start",
                    F.explode(F.sequence(F.lit(1), F.least(F.lit(max(max_len, 1)),
                                                           F.col("n") - F.col("start"))))
                    .alias("len"))
            .select("word", "n", "start", "len",
                    F.expr("substring(w1, start + 1, len)").alias("piece")))
    best = (subs.join(v, "piece")
            .groupBy("word", "n", "start")
            .agg(F.max(F.struct("len", "tid")).alias("b")))
    per_word = best.groupBy("word", "n").agg(
        F.map_from_entries(F.collect_list(F.struct("start", "b"))).alias("m"))
    init = F.struct(F.lit(0).alias("next"), F.lit(True).alias("ok"),
                    F.array().cast("array<bigint>").alias("ids"))

    def step(acc, i):
        hit = F.element_at(F.col("m"), i)
        return F.when(acc["ok"] & (acc["next"] == i),
                      F.when(hit.isNull(), F.struct(acc["next"].alias("next"),
                                                    F.lit(False).alias("ok"),
                                                    acc["ids"].alias("ids")))
                      .otherwise(F.struct((i + hit["len"]).alias("next"), F.lit(True).alias("ok"),
                                          F.concat(acc["ids"], F.array(hit["tid"])).alias("ids")))
                      ).otherwise(acc)

    walked = per_word.select(
        "word", F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), init, step).alias("r"))
    seg = walked.select("word", (F.col("r.ok") & (F.size("r.ids") > 0)).alias("known"),
                        F.col("r.ids").alias("ids"))
    out = w.select("word").join(seg, "word", "left")
    known = F.coalesce(F.col("known"), F.lit(False))
    return out.select("word", known.alias("known"),
                      F.when(known, F.col("ids")).otherwise(F.array(F.lit(unk_id).cast("bigint")))
                      .alias("piece_ids"))


def token_ids(tokens: DataFrame, vocab: DataFrame, unk_id: int = DEFAULT_UNK_ID,
              trie_chars: int = TRIE_CHARS) -> DataFrame:
    """(id, pos, token, known, piece_ids) for every token row (J4), in its place: the distinct words of each
    batch walk the trie, and no token is shuffled. By the join, segmentation of the distinct words is
    left-joined back to the tokens."""
    vocab, trie = _trie(vocab, trie_chars)
    if trie is None:
        seg = _segment_by_join(tokens.select(F.col("token").alias("word")), vocab, "word", unk_id)
        seg = cut_lineage(seg.withColumnRenamed("word", "token"), "wordpieces")
        return tokens.join(seg, "token", "left").select("id", "pos", "token", "known", "piece_ids")
    tokens = tokens.select("id", "pos", "token")
    schema = T.StructType([*tokens.schema.fields, T.StructField("known", T.BooleanType()),
                           T.StructField("piece_ids", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walked = Walked(trie.value)
        for batch in batches:
            words = batch.column(2).dictionary_encode()
            ids = walked(words.dictionary.to_pylist())
            known = pa.array([x is not None for x in ids], pa.bool_())
            lists = pa.array([[unk_id] if x is None else x for x in ids], pa.list_(pa.int64()))
            sizes = np.array([1 if x is None else len(x) for x in ids], np.int64)
            codes = words.indices                                  # null for a null token
            ends = np.cumsum(sizes[codes.fill_null(0).to_numpy()]) if len(sizes) else np.zeros(len(codes), np.int64)
            at = 0
            while at < len(codes):                                 # long words come many times over
                before = ends[at - 1] if at else 0
                n = max(1, int(np.searchsorted(ends, before + PIECES, "right")) - at)
                some = codes.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, n).columns, known.take(some), lists.take(some)], names=schema.names)
                at += n

    return tokens.mapInArrow(run, schema)


def piece_profile(tokens: DataFrame, ids: DataFrame, vocab: DataFrame, n_ctx: int = 512,
                  unk_id: int = DEFAULT_UNK_ID, trie_chars: int = TRIE_CHARS) -> DataFrame:
    """Per document of ``ids`` (id): ids including the two framing ids, unknown words,
    their share of the words (null without words), and whether the text overflows the
    context (F9). Documents without tokens have the two framing ids."""
    vocab, trie = _trie(vocab, trie_chars)
    if trie is None:
        counts = cut_lineage(tokens.groupBy("id", "token").agg(F.count("*").alias("n")), "word-counts")
        seg = _segment_by_join(counts.select(F.col("token").alias("word")), vocab, "word", unk_id)
        seg = cut_lineage(seg.select(F.col("word").alias("token"), "known",
                                     F.size("piece_ids").alias("n_pieces")), "wordpieces")
        sums = counts.join(seg, "token").select(
            "id", (F.col("n") * F.col("n_pieces")).alias("ids"), F.col("n").alias("words"),
            F.when(F.col("known"), 0).otherwise(F.col("n")).alias("unk"))
    else:
        sums = _batch_sums(tokens.select("id", "token").filter("token IS NOT NULL"), trie)
    per = sums.groupBy("id").agg(F.sum("ids").alias("_ids"), F.sum("words").alias("_words"), F.sum("unk").alias("_unk"))
    out = ids.select("id").join(per, "id", "left").select(
        "id", (F.coalesce("_ids", F.lit(0)) + 2).alias("n_ids"), F.coalesce("_unk", F.lit(0)).alias("n_unk"),
        F.round(F.col("_unk") / F.col("_words"), 6).alias("unk_share"))
    return out.withColumn("over_context", F.col("n_ids") > n_ctx)


def _batch_sums(tokens: DataFrame, trie) -> DataFrame:
    """(id, ids, words, unk): sums over the tokens of each id in an Arrow batch."""
    schema = T.StructType([tokens.schema["id"], *[T.StructField(c, T.LongType()) for c in ("ids", "words", "unk")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walked = Walked(trie.value)
        for batch in batches:
            words, id = batch.column(1).dictionary_encode(), batch.column(0).dictionary_encode("encode")
            ids = walked(words.dictionary.to_pylist())
            pieces = np.array([1 if x is None else len(x) for x in ids], np.int64)
            unknown = np.array([x is None for x in ids], np.int64)
            doc, word = id.indices.to_numpy(), words.indices.to_numpy()
            sums = np.zeros((3, len(id.dictionary)), np.int64)
            for out, n in zip(sums, (pieces[word], 1, unknown[word])):
                np.add.at(out, doc, n)
            yield pa.RecordBatch.from_arrays([id.dictionary, *map(pa.array, sums)], names=schema.names)

    return tokens.mapInArrow(run, schema)


def limited_ids(docs: DataFrame, vocab: DataFrame, n_ctx: int = 512, first_id: int = 1, last_id: int = 2,
                unk_id: int = DEFAULT_UNK_ID, id: str = "id", text: str = "text",
                trie_chars: int = TRIE_CHARS) -> DataFrame:
    """(id, ids, whole) of each text: the ids that a model of ``n_ctx`` positions reads.

    ``first_id``, the pieces, ``last_id``. Words are taken while there is room for one more id beside the
    last: a word (with the punctuation mark right after it) whose turn comes is taken with all
    its pieces, so the list may overshoot; it is then cut to ``n_ctx`` and has lost its last id
    (``whole`` is false where anything was left out). A text without tokens has the two framing
    ids; null and empty texts too.

    Each turn takes an id at least, so only the first ``n_ctx`` turns of a text are looked at: however long
    it is, a row carries no more. Its words walk the trie where the row is; by the join, they meet again
    in one bounded list."""
    vocab, trie = _trie(vocab, trie_chars)
    turns = vx.let(tx.flushes(tx.fold_text(text)), lambda t: F.struct(
        F.slice(t, 1, n_ctx).alias("turns"), (F.size(t) > n_ctx).alias("more")))
    turned = docs.select(F.col(id).alias("id"), turns.alias("_t")).select("id", "_t.turns", "_t.more")
    if trie is not None:
        return _limited(turned, trie, n_ctx, first_id, last_id, unk_id)
    rows = cut_lineage(turned.withColumn("_row", F.monotonically_increasing_id()), "turns")
    tokens = (rows.select("_row", F.posexplode("turns").alias("turn", "_t"))
              .select("_row", "turn", F.posexplode(tx.basic_tokens("_t")).alias("place", "token")))
    tokens = cut_lineage(tokens, "turn-tokens")
    seg = _segment_by_join(tokens.select(F.col("token").alias("word")), vocab, "word", unk_id)
    pieces = tokens.join(seg.select(F.col("word").alias("token"), "piece_ids"), "token").groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("turn", "place", "piece_ids"))).alias("_p"))
    start = F.struct(F.lit(-1).alias("turn"), F.lit(True).alias("taken"),
                     F.array(F.lit(first_id).cast("bigint")).alias("ids"), F.lit(True).alias("whole"))

    def take(acc, x):
        taken = F.when(x["turn"] == acc["turn"], acc["taken"]).otherwise(F.size(acc["ids"]) < n_ctx - 1)
        return F.struct(x["turn"].alias("turn"), taken.alias("taken"),
                        F.when(taken, F.concat(acc["ids"], x["piece_ids"])).otherwise(acc["ids"]).alias("ids"),
                        (acc["whole"] & taken).alias("whole"))

    empty = F.array().cast("array<struct<turn:int,place:int,piece_ids:array<bigint>>>")
    walked = rows.join(pieces, "_row", "left").select(
        "id", "more", F.aggregate(F.coalesce("_p", empty), start, take).alias("r"))
    ids = F.concat("r.ids", F.array(F.lit(last_id).cast("bigint")))
    return walked.select("id", F.slice(ids, 1, n_ctx).alias("ids"),
                         (F.col("r.whole") & ~F.coalesce("more", F.lit(False)) & (F.size("r.ids") < n_ctx)).alias("whole"))


def _limited(rows: DataFrame, trie, n_ctx: int, first_id: int, last_id: int, unk_id: int) -> DataFrame:
    """``limited_ids`` of (id, turns, more), row by row."""
    schema = T.StructType([rows.schema["id"], T.StructField("ids", T.ArrayType(T.LongType())),
                           T.StructField("whole", T.BooleanType())])
    marks = frozenset(tx.PUNCT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walked = Walked(trie.value)
        for batch in batches:
            lists, more = batch.column(1), batch.column(2).to_pylist()
            flat = lists.flatten().dictionary_encode()             # a null list has no turns
            codes = flat.indices.to_numpy()
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            # a turn is a word, a mark, or a word and the mark after it
            turns = [[t[:-1], t[-1]] if len(t) > 1 and t[-1] in marks else [t] for t in flat.dictionary.to_pylist()]
            words = list(dict.fromkeys(itertools.chain.from_iterable(turns)))
            ids = {w: [unk_id] if x is None else x for w, x in zip(words, walked(words))}
            pieces = [ids[t[0]] if len(t) == 1 else ids[t[0]] + ids[t[1]] for t in turns]
            sizes = np.array([len(p) for p in pieces], np.int64)
            found, whole = [], []
            for i, end in enumerate(ends):
                mine = codes[ends[i - 1] if i else 0:end]
                before = 1 + np.cumsum(sizes[mine]) - sizes[mine]  # ids when a turn comes
                taken = mine[before < n_ctx - 1]
                got = [first_id, *itertools.chain.from_iterable(pieces[c] for c in taken)]
                whole.append(len(taken) == len(mine) and not more[i] and len(got) < n_ctx)
                found.append([*got, last_id][:n_ctx])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(whole, pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema)


def vocab_from_text(texts: DataFrame, text: str = "text") -> DataFrame:
    """A vocabulary table from a text column: every distinct basic token as
    a word-initial piece, every distinct character as a bare and as a
    word-initial piece; ids from ``piece_id`` (0 stays ``[UNK]``)."""
    toks = texts.select(F.explode(tx.tokenize(text)).alias("t"))
    words = toks.select(F.concat(F.lit(WORD_PREFIX), "t").alias("token"))
    chars = toks.select(F.explode(F.split("t", "")).alias("c")).filter(F.col("c") != "")
    pieces = (words.unionByName(chars.select(F.col("c").alias("token")))
              .unionByName(chars.select(F.concat(F.lit(WORD_PREFIX), "c").alias("token")))
              .distinct())
    return pieces.select("token", piece_id("token").alias("token_id"))


def piece_id(col) -> "F.Column":
    """Stable 60-bit id of a piece string (first 15 hex digits of its md5):
    computed per row, so no global ordering or single task is needed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")
