"""Word helpers for the Arrow stages: white-space words of UTF-8 bytes as 64-bit hashes,
and rolling hashes of word windows, both with numpy on whole chunks of texts.

A word is ``[^\\x20\\x09-\\x0D]+``; UTF-8 never uses those six bytes inside another
character, so words are found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MULT = np.uint64(0x9E3779B97F4A7C15)          # odd, so invertible modulo 2**64
MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK = 1 << 20                               # bytes of text worked on at a time (or one text)
LONG_WORD = 64                                # bytes from which a word is hashed on its own

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of data[start:start + length], 8 bytes at a time; ``data`` ends in 8 spare bytes."""
    at_byte = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = mix(length.astype(np.uint64) * MULT)
    todo = np.arange(len(start))
    for step in range(0, LONG_WORD, 8):
        left = length[todo] - step
        todo, left = todo[left > 0], left[left > 0]
        if not len(todo):
            return out
        bits = (8 * np.minimum(left, 8)).astype(np.uint64)
        mask = ~np.uint64(0) >> (np.uint64(64) - bits)
        out[todo] = mix(out[todo] * MULT ^ (at_byte[start[todo] + step] & mask))
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[start[i]:start[i] + length[i]].tobytes())
    return out


def word_hashes(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of all words, word offsets of the rows) for chunks of a column of
    bytes; null has no words. ``lower``: A-Z count as a-z."""
    column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    every = column.buffers()[2]
    every = np.frombuffer(every, np.uint8) if every is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        cut = offsets[row:end + 1].astype(np.int64) - offsets[row]
        data = np.zeros(cut[-1] + 8, np.uint8)
        data[:-8] = every[offsets[row]:offsets[end]]
        if lower:
            data = _LOWER[data]
        space = _SPACE[data[:-8]]
        begins = ~space
        begins[1:] &= space[:-1]
        ends = ~space
        ends[:-1] &= space[1:]
        inner = cut[:-1][cut[:-1] < cut[1:]]          # first bytes of the texts that aren't empty
        begins[inner] = ~space[inner]
        last = cut[1:][cut[:-1] < cut[1:]] - 1
        ends[last] = ~space[last]
        start = np.flatnonzero(begins)
        length = np.flatnonzero(ends) + 1 - start
        yield row, _hash_words(data, start, length), np.searchsorted(start, cut)
        row = end


class Powers:
    """Powers of MULT and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, MULT))])
                self.down = np.concatenate(
                    [[np.uint64(1)], np.multiply.accumulate(np.full(size, MULT_INV))])
        return self.up[:n], self.down[:n]


def prefix_sums(w: np.ndarray, powers: Powers) -> np.ndarray:
    """P with P[i] = sum of w[t] * MULT**t over t < i, modulo 2**64."""
    up, _ = powers.get(len(w) + 1)
    out = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * up[:len(w)], out=out[1:])
    return out


def span_hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of words[start:end] for each pair, from the prefix sums."""
    _, down = powers.get(len(p))
    return mix((p[end] - p[start]) * down[start])


def window_hashes(p: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """Hash of every window of k consecutive words."""
    n = len(p) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = powers.get(len(p))
    return mix((p[k:] - p[:-k]) * down[:n])
