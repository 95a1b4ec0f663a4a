"""Alignment of two tokenizers' tokens by an associative fragment monoid.

Both tokenizers spell a document's bytes (a space, then the text). Offsets where tokens of both
end cut the tokens into groups; all A-B pairs of a group are linked.

A *fragment* describes the tokens that end in a byte range: the open prefix (tokens up to the
first common end, whose group may begin before the range), the closed groups, and the open
suffix (tokens after the last common end). ``compose`` joins two neighbouring fragments: suffix
and prefix between them close to a group. It is associative, and a range without a common end
is all prefix, so ranges may be cut anywhere and composed in any tree.

How a text is encoded in parts: neither tokenizer joins across a single space between a
character other than a space and one that surely isn't white space (A splits there, and no
piece of B holds a space mark after another character, which is checked). At such places a
text falls into *units*, which are encoded alone, and once for each batch however often they occur.

1. texts up to ``chunk`` bytes: a task takes ``PACK_BYTES`` (a *pack*) of them at a time, encodes its
   distinct units (those of earlier packs are remembered, up to ``REMEMBERED``), and composes each
   document of its units' fragments, which are closed;
2. longer texts are cut into byte ranges anywhere. A range travels with the units that overlap
   its ends, so that any task can encode it; the fragments are written and composed in rounds
   of ``FAN`` neighbours, which closes the groups across the cuts. Digests read the parts in order;
3. each pack and each long document counts its distinct id pairs; sums over the corpus give a
   pair's count, and a maximum the best of each A id;
4. the counts return to each pack by a join (its distinct pairs, not its documents' links) and
   are summed over units, then documents.

The vocabularies travel as the bytes of the two files (a broadcast of fixed size). Only a unit
longer than a range makes a task hold more than a pack. Units are told apart by 64-bit hashes within a task.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches, table
from .words import _hash_words

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 1 << 16              # bytes of a byte range; longer texts are cut
PACK_BYTES = 1 << 20         # of the texts of a pack
REMEMBERED = 1 << 19         # units whose tokens a worker keeps (some 20 MB)
FAN = 8                      # neighbouring fragments composed in a round
SPACE_MARK = "▁"
# Fixed value: the split pattern of byte-level BPE files without one of their own.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Characters on which all versions of Unicode agree: both ways of encoding by A take them alike.
_SETTLED = re.compile("[\x00-\u024F]*").fullmatch

# bytes that surely begin a character other than white space
_SURE = np.zeros(256, bool)
_SURE[0x21:0x7F] = True
_SURE[0xC3:] = True
_SURE[[0xE1, 0xE2, 0xE3]] = False


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Spelling:
    """The bytes of each id of a vocabulary, and its decimal digits."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.pool, self.start[ids], self.length[ids])


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """data[start:start + length] of all pairs, one after the other."""
    total = np.cumsum(length)
    return data[np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - length), length)]


class Tokens(NamedTuple):
    """Tokens of both kinds: ids, and the byte offsets where they end."""
    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray


class Tokenizers:
    """Both tokenizers, from the bytes of their files."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(a_file)
        vocab, letters = spec["model"]["vocab"], _byte_alphabet()
        plain = {t: bytes(letters[c] for c in t) for t in vocab}
        spelled = dict.fromkeys(range(max(vocab.values()) + 1), b"") | {i: plain[t] for t, i in vocab.items()}
        spelled |= {x["id"]: x["content"].encode() for x in spec["added_tokens"] if x["id"] not in vocab.values()}
        self.a = Spelling([spelled[i] for i in sorted(spelled)])
        self.whole = Tokenizer.from_str(a_file.decode())
        self.whole.encode_special_tokens = True
        # ids in the order of the merges: then merging by lowest id is the same, and faster
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        self.ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={plain[t]: i for t, i in vocab.items()},
                                       special_tokens={}) if made == sorted(made) else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        n = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in names):
            raise ValueError("a piece holds a space after another character: texts can't be encoded in parts")
        self.b = Spelling([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                           for i, p in enumerate(names)])
        self.n_b = n
        top = max(n, len(self.a.length))
        self.digits = Spelling([str(i).encode() for i in range(top)])
        self.hashes = np.zeros(0, np.uint64)              # of the units remembered, in order
        none = np.zeros(0, np.int32)
        self.spelled = Spelled(none.astype(bool), none, none.astype(np.int64), none, none.astype(np.int64))

    def encode_a(self, units: list[bytes]) -> list[list[int]]:
        texts = [u.decode("utf-8", "replace") for u in units]
        if self.ranks is None:
            rest, out = list(range(len(units))), [[]] * len(units)
        else:
            out = [self.ranks.encode_ordinary(t) if _SETTLED(t) else None for t in texts]
            rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.whole.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = x.ids
        return out

    def encode_b(self, units: list[bytes]) -> list[list[int]]:
        """B adds the space that every unit begins with."""
        return self.pieces.encode([u[1:].decode("utf-8", "replace") for u in units], num_threads=1)

    def spell(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> "Spelled":
        """Tokens of the units data[start:start + length]; units that A or B doesn't spell have none."""
        units = [data[s:s + n].tobytes() for s, n in zip(start.tolist(), length.tolist())]
        fine, got = np.ones(len(units), bool), []
        for lists, spelling in ((self.encode_a(units), self.a), (self.encode_b(units), self.b)):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(n.sum()))
            unit = np.repeat(np.arange(len(units)), n)
            same = np.bincount(unit, spelling.length[ids], len(units)).astype(np.int64) == length
            ok = same[unit]
            u = np.repeat(np.flatnonzero(same), length[same])
            same[u[spelling.bytes(ids[ok]) != gather(data, start[same], length[same])]] = False
            fine &= same
            got.append((ids, n))
        for i, (ids, n) in enumerate(got):
            got[i] = (ids[np.repeat(fine, n)], np.where(fine, n, 0))
        return Spelled(fine, *got[0], *got[1])

    def encode(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray
               ) -> tuple[Tokens, np.ndarray]:
        """Tokens of units with their ``hashes`` (rising), with ends counted over all units, and which
        units both spell. The others have no tokens and no bytes."""
        known = np.searchsorted(self.hashes, hashes)
        there = known < len(self.hashes)
        there[there] = self.hashes[known[there]] == hashes[there]
        if not there.all():
            new = ~there
            found = self.spell(data, start[new], length[new])
            if len(self.hashes) + len(found.fine) > REMEMBERED:
                keep = known[there]                       # of the units kept so far, those of this call
                self.hashes, self.spelled = self.hashes[keep], self.spelled.take(keep)
            both = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(both)
            self.hashes, self.spelled = both[order], self.spelled.extended(found).take(order)
            known = np.searchsorted(self.hashes, hashes)
        x = self.spelled.take(known)
        return Tokens(x.a, np.cumsum(self.a.length[x.a]), x.b, np.cumsum(self.b.length[x.b])), x.fine


class Spelled(NamedTuple):
    """Units: whether both tokenizers spell them, ids of all and how many each has."""
    fine: np.ndarray
    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray

    def take(self, units: np.ndarray) -> "Spelled":
        def part(ids, n):
            return gather(ids, (np.cumsum(n) - n)[units], n[units]), n[units]
        return Spelled(self.fine[units], *part(self.a, self.n_a), *part(self.b, self.n_b))

    def extended(self, more: "Spelled") -> "Spelled":
        return Spelled(*(np.concatenate(x) for x in zip(self, more)))


_LOADED: dict = {}


def _load(shared) -> Tokenizers:
    """The tokenizers of a broadcast, once for each Python worker."""
    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizers(*shared.value)
    return _LOADED[key]


def common_ends(t: Tokens) -> np.ndarray:
    return np.intersect1d(t.a_end, t.b_end, assume_unique=True)


class Groups(NamedTuple):
    """Closed groups: how many tokens of each kind, the text ``a1,a2|b1;`` of all, where the text
    of each group ends, and the links: group, id pair, how often."""
    n_a: np.ndarray
    n_b: np.ndarray
    text: np.ndarray
    text_end: np.ndarray
    group: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different values in order, how often) of whole numbers."""
    x = np.sort(x)
    first = np.flatnonzero(np.diff(x, prepend=x[:1] - 1))
    return x[first], np.diff(np.append(first, len(x)))


def _by_id(group: np.ndarray, ids: np.ndarray, top: int):
    """Distinct ids of each group: (group, id, times)."""
    key, times = distinct(group * top + ids)
    return key // top, key % top, times


def closed_groups(t: Tokens, cuts: np.ndarray, tok: Tokenizers) -> Groups:
    """The groups that ``cuts`` (the last of them the end of all tokens) close."""
    ga, gb = np.searchsorted(cuts, t.a_end), np.searchsorted(cuts, t.b_end)
    n_a, n_b = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
    upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
    # text: the A ids of a group, then its B ids, each followed by one sign
    ids, sign = np.zeros(len(t.a) + len(t.b), np.int64), np.full(len(t.a) + len(t.b), ord(","), np.uint8)
    at_a = np.arange(len(t.a)) + (upto_b - n_b)[ga]
    at_b = np.arange(len(t.b)) + upto_a[gb]
    ids[at_a], ids[at_b] = t.a, t.b
    sign[at_a[upto_a[n_a > 0] - 1]] = ord("|")
    sign[at_b[upto_b[n_b > 0] - 1]] = ord(";")
    length = tok.digits.length[ids]
    end = np.cumsum(length + 1)
    text = np.empty(end[-1] if len(end) else 0, np.uint8)
    text[end - 1] = sign
    text[np.arange(int(length.sum())) + np.repeat(np.arange(len(ids)), length)] = tok.digits.bytes(ids)
    # links: distinct A ids of a group times its distinct B ids
    xg, xa, xn = _by_id(ga, t.a, len(tok.a.length))
    yg, yb, yn = _by_id(gb, t.b, tok.n_b)
    ys = np.bincount(yg, minlength=len(cuts))
    first = np.cumsum(ys) - ys
    many = ys[xg]
    x = np.repeat(np.arange(len(xg)), many)
    y = first[xg[x]] + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
    return Groups(n_a, n_b, text, end[upto_a + upto_b - 1] if len(end) else end, xg[x],
                  xa[x] * tok.n_b + yb[y], xn[x] * yn[y])


# -- fragments -------------------------------------------------------------------

class Fragment(NamedTuple):
    """What a byte range leaves open: ``head_*`` (tokens up to its first common end, closed by
    range number ``first``), ``tail_*``; without a common end (``first`` None) all is head."""
    first: int | None
    head_a: list
    head_b: list
    tail_a: list
    tail_b: list


def fragment(t: Tokens, number: int, tok: Tokenizers) -> tuple[Fragment, Groups]:
    """The open ends and the closed groups of the tokens of one range."""
    cuts = common_ends(t)
    if not len(cuts):
        none = Tokens(*[x[:0] for x in t])
        return Fragment(None, t.a.tolist(), t.b.tolist(), [], []), closed_groups(none, cuts, tok)
    ia, ib = (np.searchsorted(e, [cuts[0], cuts[-1]], "right") for e in (t.a_end, t.b_end))
    inner = Tokens(t.a[ia[0]:ia[1]], t.a_end[ia[0]:ia[1]], t.b[ib[0]:ib[1]], t.b_end[ib[0]:ib[1]])
    open_ends = (t.a[:ia[0]], t.b[:ib[0]], t.a[ia[1]:], t.b[ib[1]:])
    return Fragment(number, *(x.tolist() for x in open_ends)), closed_groups(inner, cuts[1:], tok)


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, tuple | None]:
    """Two neighbouring fragments as one, and the group that closes between them:
    (number of the range that closes it, A ids, B ids)."""
    if y.first is None and x.first is None:
        return Fragment(None, x.head_a + y.head_a, x.head_b + y.head_b, [], []), None
    if y.first is None:
        return x._replace(tail_a=x.tail_a + y.head_a, tail_b=x.tail_b + y.head_b), None
    if x.first is None:
        return y._replace(head_a=x.head_a + y.head_a, head_b=x.head_b + y.head_b), None
    return (Fragment(x.first, x.head_a, x.head_b, y.tail_a, y.tail_b),
            (y.first, x.tail_a + y.head_a, x.tail_b + y.head_b))


# -- units and ranges ------------------------------------------------------------

def unit_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where units start in texts that begin (with their added space) at ``begins``."""
    if not len(data):
        return np.zeros(0, np.int64)
    cut = data == 0x20
    cut[1:] &= data[:-1] != 0x20
    cut[:-1] &= _SURE[data[1:]]
    cut[-1] = False
    cut[begins] = True
    last = begins[1:] - 1                   # a text's last byte: what follows is another text
    cut[last[~np.isin(last, begins)]] = False
    return np.flatnonzero(cut)


def ranges(text: bytes, chunk: int) -> list[tuple[int, bytes, int, int]]:
    """(number, window, from, to) of a text's byte ranges: tokens that end after ``from`` and up to
    ``to`` in the window are the range's. Cuts fall every ``chunk`` bytes, but none in a unit longer than that."""
    data = np.frombuffer(b" " + text, np.uint8)
    starts = np.append(unit_starts(data, np.zeros(1, np.int64)), len(data))
    p = np.arange(chunk, len(data), chunk)
    before = starts[np.searchsorted(starts, p, "right") - 1]
    after = starts[np.searchsorted(starts, p, "left")]
    keep = after - before <= chunk
    p, before, after = p[keep].tolist(), before[keep].tolist(), after[keep].tolist()
    whole = data.tobytes()
    out = []
    for i, (lo, s, e, hi) in enumerate(zip([0, *p], [0, *before], [*after, len(data)], [*p, len(data)])):
        out.append((i, whole[s:e], lo - s, hi - s))
    return out


def _cut_texts(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in ranges(text.as_py(), chunk):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.int64()), pa.array([part[0]], pa.int32()), pa.array([part[1]], pa.binary()),
                         pa.array([part[2]], pa.int64()), pa.array([part[3]], pa.int64())],
                        names=["row", "at", "window", "lo", "hi"])
    return run


def encoded(window: bytes, tok: Tokenizers) -> Tokens | None:
    """Tokens of a window of whole units; None where they don't spell it."""
    data = np.zeros(len(window) + 8, np.uint8)
    data[:-8] = np.frombuffer(window, np.uint8)
    start = unit_starts(data[:-8], np.zeros(1, np.int64))
    found = tok.spell(data, start, np.diff(np.append(start, len(window))))
    if not found.fine.all():
        return None
    return Tokens(found.a, np.cumsum(tok.a.length[found.a]), found.b, np.cumsum(tok.b.length[found.b]))


OPEN = "row long, at int, first int, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>"
PART = ("row long, at int, later int, ok boolean, n_a long, n_b long, n_groups long, n_links long, "
        "text binary, pair array<long>, times array<long>")


def _part(row: int, at: int, later: int, g: Groups) -> dict:
    pair, where = np.unique(g.pair, return_inverse=True)
    times = np.zeros(len(pair), np.int64)
    np.add.at(times, where, g.times)
    return {"row": row, "at": at, "later": later, "ok": True, "n_a": int(g.n_a.sum()), "n_b": int(g.n_b.sum()),
            "n_groups": len(g.n_a), "n_links": int((g.n_a * g.n_b).sum()), "text": g.text.tobytes(),
            "pair": pair, "times": times}


_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(),
          "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
          "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[k]) for n, k in fields],
                                      names=[n for n, _ in fields])


def _fragments(shared):
    """Each range's closed part and open ends, as one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _load(shared)
        for batch in batches:
            for r in batch.to_pylist():
                t = encoded(r["window"], tok)
                if t is None:
                    yield _batch([{"row": r["row"], "at": r["at"], "later": 1, "ok": False, "n_a": 0, "n_b": 0,
                                   "n_groups": 0, "n_links": 0, "text": b"", "pair": [], "times": [], "first": None,
                                   "head_a": [], "head_b": [], "tail_a": [], "tail_b": []}], f"{PART}, {OPEN[18:]}")
                    continue
                a = slice(*np.searchsorted(t.a_end, [r["lo"], r["hi"]], "right"))
                b = slice(*np.searchsorted(t.b_end, [r["lo"], r["hi"]], "right"))
                f, g = fragment(Tokens(t.a[a], t.a_end[a], t.b[b], t.b_end[b]), r["at"], tok)
                yield _batch([_part(r["row"], r["at"], 1, g) | f._asdict()], f"{PART}, {OPEN[18:]}")
    return run


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring fragments as one, with the groups that close between them."""
    fields = ("first", "head_a", "head_b", "tail_a", "tail_b")
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            parts = sorted(r["parts"], key=lambda p: p["at"])
            whole, closed = Fragment(*(parts[0][k] for k in fields)), []
            for p in parts[1:]:
                whole, group = compose(whole, Fragment(*(p[k] for k in fields)))
                if group:
                    closed.append(dict(zip(("at", "a", "b"), group)))
            rows.append({"row": r["row"], "at": r["at"], "closed": closed} | whole._asdict())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in rows], _TYPES[k]) for n, k in (f.split(" ") for f in OPEN.split(", "))]
            + [pa.array([r["closed"] for r in rows], pa.list_(pa.struct(
                [("at", pa.int32()), ("a", _TYPES["array<int>"]), ("b", _TYPES["array<int>"])])))],
            names=[*(f.split(" ")[0] for f in OPEN.split(", ")), "closed"])


def _joints(shared):
    """Groups that closed across ranges, as parts that stand before their range's own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _load(shared)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, b = (np.array(r[k], np.int64) for k in "ab")
                ends = [np.append(np.arange(1, len(x)), 1 << 40) for x in (a, b)]     # any ends but one in common
                g = closed_groups(Tokens(a, ends[0], b, ends[1]), np.array([1 << 40]), tok)
                rows.append(_part(r["row"], r["at"], 0, g))
            yield _batch(rows, PART)
    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, sha) of the parts of each row, which come in order."""
    row, sha, held = None, None, b""
    for batch in batches:
        out = []
        for r, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if r != row:
                if row is not None:
                    sha.update(held[:-1])
                    out.append({"row": row, "sha": sha.hexdigest()})
                row, sha, held = r, hashlib.sha256(), b""
            if len(text.as_py()):
                sha.update(held)
                held = text.as_py()
        yield _batch(out, "row long, sha string")
    if row is not None:
        sha.update(held[:-1])
        yield _batch([{"row": row, "sha": sha.hexdigest()}], "row long, sha string")


# -- packs -----------------------------------------------------------------------

PACK = ("pack long, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
        "pair array<long>, docs array<int>, doc_n binary, unit binary, unit_n binary, link binary, often binary, times binary")


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 up, in as few bytes each as the largest needs: one value to the table, not a list."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return kind.char.encode() + x.astype(kind).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x[1:], x[:1].decode()).astype(np.int64)


def _per(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` that end at ``end``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], end])])


def pack(texts: list[bytes | None], tok: Tokenizers) -> dict:
    """What a batch of documents holds: figures of each, its units, links of the units, and
    for each id pair in how many of the documents it is linked."""
    texts = [b" " + t if t else b"" for t in texts]
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    full = size > 0
    start = unit_starts(data[:-8], (np.cumsum(size) - size)[full])
    length = np.diff(np.append(start, size.sum()))
    doc = np.searchsorted(np.cumsum(size), start, "right")
    hashes = _hash_words(data, start, length)
    order = np.argsort(hashes)
    new = np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0
    one = order[new]
    unit = np.empty(len(order), np.int64)
    unit[order] = np.cumsum(new) - 1
    t, fine = tok.encode(data, start[one], length[one], hashes[one])
    bad = np.zeros(len(texts), bool)
    bad[doc[~fine[unit]]] = True
    keep = ~bad[doc]
    doc, unit = doc[keep], unit[keep]
    cuts = common_ends(t)
    g = closed_groups(t, cuts, tok)
    ends = np.cumsum(np.where(fine, length[one], 0))
    of = np.searchsorted(ends, cuts)                       # the unit of each group
    n = len(one)
    figures = {k: np.bincount(of, v, n).astype(np.int64) for k, v in (
        ("n_a", g.n_a), ("n_b", g.n_b), ("n_groups", np.ones(len(of))), ("n_links", g.n_a * g.n_b))}
    text_end = np.concatenate([[0], g.text_end])[np.cumsum(figures["n_groups"])]
    text, raw = [], g.text.tobytes()
    for s, e in zip(np.concatenate([[0], text_end]).tolist(), text_end.tolist()):
        text.append(raw[s:e])
    doc_end = np.searchsorted(doc, np.arange(len(texts)), "right")
    sha, s = [], 0
    units = unit.tolist()
    for e in doc_end.tolist():
        sha.append(hashlib.sha256(b"".join([text[u] for u in units[s:e]])[:-1]).hexdigest() if e > s else "")
        s = e
    # links of a unit: its groups come in order, and each group's links together
    pair, link = np.unique(g.pair, return_inverse=True)
    unit_end = np.searchsorted(of[g.group], np.arange(n), "right")
    # distinct (document, pair): of its distinct units first
    seen, _ = distinct(doc * n + unit)
    at, u = seen // max(n, 1), seen % max(n, 1)
    begin = np.concatenate([[0], unit_end[:-1]]) if n else unit_end
    many = (unit_end - begin)[u]
    held = gather(link, begin[u], many)
    held, _ = distinct(np.repeat(at, many) * max(len(pair), 1) + held)
    docs = np.bincount(held % max(len(pair), 1), minlength=len(pair))
    often = np.flatnonzero(g.times > 1)                    # most links of a unit occur once in it
    return {k: _per(v[unit], doc_end) for k, v in figures.items()} | {
        "sha": sha, "pair": pair, "docs": docs, "doc_n": packed(np.diff(doc_end, prepend=0)), "unit": packed(unit),
        "unit_n": packed(unit_end - begin), "link": packed(link), "often": packed(often), "times": packed(g.times[often])}


def _packs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _load(shared)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                full = (upto[at - 1] if at else 0) + PACK_BYTES
                part = batch.slice(at, max(1, int(np.searchsorted(upto, full, "right")) - at))
                at += part.num_rows
                found = pack(part.column(1).to_pylist(), tok) | {"pack": number}
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                out = _batch([found], PACK)
                yield pa.RecordBatch.from_arrays([*out.columns, ids], names=[*out.schema.names, "ids"])
                number += 1
    return run


def _score_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the packs with their sums over links."""
    for batch in batches:
        for i in range(batch.num_rows):
            def of(name):
                x = batch.column(batch.schema.get_field_index(name))
                return x.values.slice(x.offsets[i].as_py(), x.offsets[i + 1].as_py() - x.offsets[i].as_py())
            got = {k: unpacked(batch.column(batch.schema.get_field_index(k))[i].as_py()) for k in
                   ("doc_n", "unit", "unit_n", "link", "often", "times")}
            times = np.ones(len(got["link"]), np.int64)
            times[got["often"]] = got["times"]
            pair, found = of("pair").to_numpy(zero_copy_only=False), of("found")
            places = np.searchsorted(pair, found.field("pair").to_numpy(zero_copy_only=False))
            sums = []
            for name in ("best", "count"):
                value = np.zeros(len(pair), np.int64)
                value[places] = found.field(name).to_numpy(zero_copy_only=False)
                per_unit = _per(value[got["link"]] * times, np.cumsum(got["unit_n"]))
                sums.append(_per(per_unit[got["unit"]], np.cumsum(got["doc_n"])))
            yield pa.RecordBatch.from_arrays(
                [of("ids"), *(of(k) for k in ("n_a", "n_b", "n_groups", "n_links")),
                 *(pa.array(x) for x in sums), of("sha")],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha"])


# -- the operator ----------------------------------------------------------------

RESULT = ("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, sha string")


def _long_parts(texts: DataFrame, shared, chunk: int) -> DataFrame:
    """(``PART``) of the texts (row, text as bytes): closed parts of all ranges and the groups that
    closed across them."""
    windows = cut_lineage(
        texts.transform(map_batches, _cut_texts(chunk), "row long, at int, window binary, lo long, hi long")
        .repartition("row", "at"), "ranges")
    found = cut_lineage(windows.transform(map_batches, _fragments(shared), f"{PART}, {OPEN[18:]}"), "fragments")
    names = [f.split(" ")[0] for f in PART.split(", ")]
    level = found.select(*[f.split(" ")[0] for f in OPEN.split(", ")])
    joints = []
    left = int(found.agg(F.max("at")).first()[0] or 0) + 1
    while left > 1:
        left = math.ceil(left / FAN)
        step = level.groupBy("row", F.expr(f"cast(at div {FAN} as int)").alias("_up")).agg(
            F.collect_list(F.struct("at", "first", "head_a", "head_b", "tail_a", "tail_b")).alias("parts"))
        level = cut_lineage(step.select("row", F.col("_up").alias("at"), "parts").transform(
            map_batches, _compose, f"{OPEN}, closed array<struct<at:int,a:array<int>,b:array<int>>>"), "composed")
        joints.append(level.select("row", F.explode("closed").alias("g")).select("row", "g.at", "g.a", "g.b"))
    # a document begins and ends at common ends: its head is a group of its own, its tail empty
    joints.append(level.filter("first IS NOT NULL AND size(head_a) > 0").select(
        "row", F.col("first").alias("at"), F.col("head_a").alias("a"), F.col("head_b").alias("b")))
    closed = functools.reduce(DataFrame.unionByName, joints).transform(map_batches, _joints(shared), PART)
    return found.select(*names).unionByName(closed)


def align(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS,
          a_file: str = A_FILE, b_file: str = B_FILE, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of ``docs``: id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose
    count is the highest of their A id), count_sum, groups_sha256.

    A pair's count is the number of rows that hold it linked; repeated rows count each. Null and
    empty texts, and texts that a tokenizer doesn't spell, have no tokens: zeros and ''. Ids may
    be null, repeated and of any type; other columns play no part. An empty table gives no rows."""
    spark = docs.sparkSession
    files = [open(os.path.join(tokenizers, f), "rb") for f in (a_file, b_file)]
    shared = spark.sparkContext.broadcast(tuple(f.read() for f in files))
    for f in files:
        f.close()
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["id"]
    big = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    packs = cut_lineage(rows.filter(~big).transform(map_batches, _packs(shared), f"{PACK}, ids array<{kind}>"),
                        "packs")
    texts = cut_lineage(rows.filter(big).withColumn("row", F.monotonically_increasing_id()), "long")
    parts = cut_lineage(_long_parts(texts.select("row", "text"), shared, chunk), "parts")
    fine = parts.groupBy("row").agg(F.min("ok").alias("ok"), *[F.sum(c).alias(c) for c in (
        "n_a", "n_b", "n_groups", "n_links")]).filter("ok")
    links = cut_lineage(
        parts.select("row", F.explode(F.arrays_zip("pair", "times")).alias("l"))
        .groupBy("row", "l.pair").agg(F.sum("l.times").alias("times"))
        .join(fine.select("row"), "row", "left_semi"), "links")

    # counts of pairs, and whether a pair has the highest of its A id
    n_b = _pieces(shared)
    held = packs.select("pack", F.explode(F.arrays_zip("pair", "docs")).alias("l")).select("pack", "l.pair", "l.docs")
    counts = cut_lineage(held.select("pair", F.col("docs").cast("long").alias("n"))
                         .unionByName(links.select("pair", F.lit(1).cast("long").alias("n")))
                         .groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    top = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("count").alias("top"))
    scored = counts.withColumn("a", F.expr(f"pair div {n_b}")).join(top, "a").select(
        "pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    scored = cut_lineage(scored, "counts")

    # packs: counts of the pairs of each; documents without any token keep zeros
    found = held.select("pack", "pair").join(scored, "pair").groupBy("pack").agg(
        F.collect_list(F.struct("pair", "count", "best")).alias("found"))
    empty = F.array().cast("array<struct<pair:bigint,count:bigint,best:bigint>>")
    short = (packs.join(found, "pack", "left").withColumn("found", F.coalesce("found", empty))
             .select("ids", "n_a", "n_b", "n_groups", "n_links", "sha", "pair", "doc_n", "unit", "unit_n", "link",
                     "often", "times", "found")
             .transform(map_batches, _score_packs, f"id {kind}, {RESULT}"))

    sums = links.join(scored, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    # Dealt out anew from the written table: behind a join, which adaptive execution may split, a
    # document's parts could stand in several tasks.
    digests = (parts.select("row", "text", "at", "later")
               .repartition("row").sortWithinPartitions("row", "at", "later").select("row", "text")
               .transform(map_batches, _digests, "row long, sha string"))
    zero = F.lit(0).cast("long")
    long = (texts.select("row", "id").join(fine, "row", "left").join(sums, "row", "left").join(digests, "row", "left")
            .select("id", *[F.coalesce(c, zero).alias(c) for c in (
                "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                F.when(F.col("ok"), F.col("sha")).otherwise("").alias("sha")))
    return short.unionByName(long).withColumnsRenamed({"id": id, "sha": "groups_sha256"})


def _pieces(shared) -> int:
    """Ids of B."""
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=shared.value[1]).get_piece_size()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links of two public tokenizers."""
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))
