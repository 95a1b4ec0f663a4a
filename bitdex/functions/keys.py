"""Bit keys: sign packing, Hamming distance, hex form, confidence helpers.

A ``k``-bit key is stored as ``ceil(k / 64)`` BIGINT columns ``w0, w1, ...``.
Component ``b`` is bit ``63 - b % 64`` of word ``b // 64`` (most significant
bit first), so the concatenated big-endian hex of the words is the byte
order of a packed 32-byte key. A last word with fewer than 64 components is
padded with zero bits at the low end, which does not change any distance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values for 256-bit keys (scaled by k / 256 for other key sizes):
# distance below 60 is a strong match, 60..76 relevant, 77..82 weak, and
# above 82 no confident match (flagged "low"). Histogram bins are 8 wide.
STRONG_BELOW = 60
RELEVANT_UPTO = 76
LOW_ABOVE = 82
REFERENCE_BITS = 256
BIN_WIDTH = 8
# A histogram bin is hidden when empty, more than this many bits past the
# nearest distance, and below this bin index (for 256-bit keys).
HIDE_MARGIN = 40
HIDE_BELOW_BIN = 24
# ---------------------------------------------------------------------------


def n_words(k: int) -> int:
    return (k + 63) // 64


def word_cols(k: int, prefix: str = "w") -> list[str]:
    return [f"{prefix}{i}" for i in range(n_words(k))]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sign_pack(y: Column | str, k: int) -> list[Column]:
    """Bit ``b`` is 1 iff ``y[b] > 0`` strictly; 0 and NaN give 0 (V6).

    Returns one BIGINT column per 64 components.
    """
    yc = _c(y)
    words = []
    for j in range(n_words(k)):
        width = min(64, k - 64 * j)
        part = F.slice(yc, 64 * j + 1, width)
        acc = F.aggregate(
            part, F.lit(0).cast("bigint"),
            lambda a, x: F.shiftleft(a, 1).bitwiseOR(
                F.when((x > 0) & ~F.isnan(x), F.lit(1).cast("bigint"))
                .otherwise(F.lit(0).cast("bigint"))),
        )
        if width < 64:
            acc = F.shiftleft(acc, 64 - width)
        words.append(acc)
    return words


def hamming(a: list[Column | str], b: list[Column | str]) -> Column:
    """Popcount of the XOR over all words (V8)."""
    total = None
    for x, y in zip(a, b):
        term = F.bit_count(_c(x).bitwiseXOR(_c(y)))
        total = term if total is None else total + term
    return total.cast("int")


def key_hex(words: list[Column | str]) -> Column:
    """Big-endian hex of the key: 16 hex digits per word (V7)."""
    return F.lower(F.concat(*[F.lpad(F.hex(_c(w)), 16, "0") for w in words]))


def key_bytes(words: list[Column | str]) -> Column:
    """The key as BINARY, most significant byte first (V7)."""
    return F.unhex(key_hex(words))


def est_cosine(d: Column | str, k: int) -> Column:
    """Cosine implied by a Hamming distance: ``cos(pi * d / k)`` (V9)."""
    return F.cos(F.lit(math.pi) * _c(d) / F.lit(float(k)))


def _scaled(threshold: int, k: int) -> float:
    return threshold * k / REFERENCE_BITS


def low_flag(d: Column | str, k: int) -> Column:
    """True past the low-confidence distance."""
    return _c(d) > F.lit(_scaled(LOW_ABOVE, k))


def confidence_band(d: Column | str, k: int) -> Column:
    """strong / relevant / weak / none."""
    dc = _c(d)
    return (
        F.when(dc < F.lit(_scaled(STRONG_BELOW, k)), F.lit("strong"))
        .when(dc <= F.lit(_scaled(RELEVANT_UPTO, k)), F.lit("relevant"))
        .when(dc <= F.lit(_scaled(LOW_ABOVE, k)), F.lit("weak"))
        .otherwise(F.lit("none"))
    )


def n_bins(k: int) -> int:
    """Bins of width 8; the last bin holds only ``d = k`` when 8 divides k."""
    return k // BIN_WIDTH + 1


def hist_bin(d: Column | str, k: int) -> Column:
    return F.least(F.floor(_c(d) / BIN_WIDTH), F.lit(n_bins(k) - 1)).cast("int")


def bin_low(b: Column | str) -> Column:
    return (_c(b) * BIN_WIDTH).cast("int")


def bin_high(b: Column | str, k: int) -> Column:
    """``8i + 7``, except the last bin, whose top is ``k``."""
    bc = _c(b)
    return F.when(bc == F.lit(n_bins(k) - 1), F.lit(k)) \
        .otherwise(bc * BIN_WIDTH + BIN_WIDTH - 1).cast("int")


def visible_bin(b: Column | str, count: Column | str, min_d: Column | str,
                k: int) -> Column:
    """Hide a bin iff empty, past ``min_d + 40`` and below bin 24 (V11);
    the margin and bin limit scale with ``k``."""
    bc = _c(b)
    hide = (
        (_c(count) == 0)
        & (bc * BIN_WIDTH > _c(min_d) + F.lit(_scaled(HIDE_MARGIN, k)))
        & (bc < F.lit(_scaled(HIDE_BELOW_BIN, k)))
    )
    return ~hide
