"""Column functions for body selection, titles, folding and basic tokens.

Every function takes and returns a ``Column`` and is built from Spark SQL
built-ins only, so it stays inside the JVM (no Python worker) and is usable
inside higher-order-function lambdas (``F.transform`` etc.).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour).
#
# Python's ``\s`` on ``str`` (``str.isspace``) matches exactly these 29 code
# points: U+0009..U+000D, U+001C..U+0020, U+0085, U+00A0, U+1680,
# U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
# Java's ``\s`` (what Spark regexes use) misses most of them, so the class is
# spelled out.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Sentence terminators used by the cap and by the sentence split.
SENTENCE_END = "[.!?]"
# Title used as the extraction query when an article has no title.
DEFAULT_TITLE_QUERY = "article"
# Default body budget (characters) and long-article threshold (characters).
DEFAULT_CAP = 1200
DEFAULT_LONG = 8000
# Minimum number of units for extractive selection; units must be longer
# than one character.
MIN_UNITS = 4

# Tokenizer classes (ASCII): space is " \t\n\v\f\r"; punctuation is every
# printable non-alphanumeric ASCII character (33-47, 58-64, 91-96, 123-126).
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
PUNCT = "".join(chr(c) for c in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)))
# Folding exceptions to the NFD rule below: letters with no canonical
# decomposition that still fold to an ASCII base.
FOLD_EXCEPTIONS = {"\u0131": "i", "\u013f": "l", "\u0140": "l", "\u017f": "s"}
# Punctuation folds: U+00A0 is a space; U+2010..U+2015 are "-";
# U+2018, U+2019, U+02BB are "'"; U+201C, U+201D are '"'.
PUNCT_FOLDS = {
    "\u00a0": " ",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-",
    "\u2014": "-", "\u2015": "-",
    "\u2018": "'", "\u2019": "'", "\u02bb": "'",
    "\u201c": '"', "\u201d": '"',
}
# Combining marks U+0300..U+036F are dropped (they do not break a word).
COMBINING_FIRST, COMBINING_LAST = 0x0300, 0x036F
# ---------------------------------------------------------------------------


def _fold_letter(cp: int) -> str | None:
    """ASCII base of a Latin-1 Supplement / Latin Extended-A letter, or None.

    Rule: the first code point of the canonical decomposition, if it is an
    ASCII letter, lower-cased; plus ``FOLD_EXCEPTIONS``.
    """
    ch = chr(cp)
    if ch in FOLD_EXCEPTIONS:
        return FOLD_EXCEPTIONS[ch]
    base = unicodedata.normalize("NFD", ch)[0]
    if base.isascii() and base.isalpha():
        return base.lower()
    return None


def fold_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``; chars of ``from`` past ``len(to)``
    are deleted (the combining marks)."""
    src, dst = [], []
    for c in range(ord("A"), ord("Z") + 1):
        src.append(chr(c))
        dst.append(chr(c + 32))
    for cp in range(0x00C0, 0x0180):
        base = _fold_letter(cp)
        if base is not None:
            src.append(chr(cp))
            dst.append(base)
    for k, v in PUNCT_FOLDS.items():
        src.append(k)
        dst.append(v)
    for cp in range(COMBINING_FIRST, COMBINING_LAST + 1):
        src.append(chr(cp))
    return "".join(src), "".join(dst)


_FOLD_FROM, _FOLD_TO = fold_table()
_WORD = "[^" + PUNCT_CLASS[1:-1] + r" \t\n\x0b\f\r]+"
TOKEN_PATTERN = f"({PUNCT_CLASS}|{_WORD})"
# A word is ended by white space or by a punctuation mark, which comes with it.
FLUSH_PATTERN = f"({_WORD[:-1]}*{PUNCT_CLASS}|{_WORD})"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# -- P1 / P10 ---------------------------------------------------------------

def non_empty(col: Column | str) -> Column:
    """Predicate: not null and not the empty string."""
    c = _c(col)
    return c.isNotNull() & (c != F.lit(""))


def has_content(col: Column | str) -> Column:
    """Predicate: at least one non-whitespace character. A selected body is
    empty exactly when the text is whitespace only (units are longer than one
    character and a lead of a non-blank text keeps its first sentence), so
    this is P10 applied before any work is spent on the row."""
    return F.regexp_like(_c(col), F.lit("[^" + WS[1:]))


# -- P2 ---------------------------------------------------------------------

def normalize_ws(col: Column | str) -> Column:
    """Collapse each run of Unicode whitespace to one space and strip."""
    return F.trim(F.regexp_replace(_c(col), WS + "+", " "))


def strip_ws(col: Column | str) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(col), f"^{WS}+|{WS}+$", "")


# -- P3 / P4 ----------------------------------------------------------------

def sentence_cap(col: Column | str, cap: int = DEFAULT_CAP) -> Column:
    """If longer than ``cap``: cut at ``cap`` chars, then after the last
    sentence end followed by whitespace (stripped); with no sentence end the
    raw cut is kept unstripped. Otherwise unchanged."""
    def capped(cut: Column) -> Column:
        return let(F.regexp_extract(cut, f"(?s)^(.*{SENTENCE_END}{WS})", 1),
                   lambda upto: F.when(upto != F.lit(""), strip_ws(upto)).otherwise(cut))
    # each step is bound once: a CASE would evaluate its input for every use
    return let(_c(col), lambda c: F.when(
        F.length(c) > F.lit(cap), let(F.substring(c, 1, cap), capped)).otherwise(c))


def lead(col: Column | str, cap: int = DEFAULT_CAP) -> Column:
    """Normalised text capped on a sentence boundary."""
    return sentence_cap(normalize_ws(col), cap)


# -- P5 / P6 / P7 -----------------------------------------------------------

def is_long(col: Column | str, long: int = DEFAULT_LONG) -> Column:
    """Raw text length strictly greater than ``long``."""
    return F.length(_c(col)) > F.lit(long)


def split_units(col: Column | str) -> Column:
    """Paragraphs (split at blank lines, normalised, length > 1); when fewer
    than ``MIN_UNITS`` remain, sentences of the normalised text instead."""
    c = _c(col)
    paras = F.filter(
        F.transform(F.split(c, f"\n{WS}*\n", -1), lambda p: normalize_ws(p)),
        lambda p: F.length(p) > 1,
    )
    sents = F.filter(
        F.split(normalize_ws(c), f"(?<={SENTENCE_END}){WS}+", -1),
        lambda p: F.length(p) > 1,
    )
    # bind the paragraphs once: a CASE branch would evaluate them again
    return F.element_at(F.transform(F.array(paras), lambda ps: F.when(
        F.size(ps) < MIN_UNITS, sents).otherwise(ps)), 1)


def is_extractive(text: Column | str, units: Column | str,
                  long: int = DEFAULT_LONG) -> Column:
    """Route predicate: long text and at least ``MIN_UNITS`` units."""
    return is_long(text, long) & (F.size(_c(units)) >= MIN_UNITS)


# -- P8 / P9 ----------------------------------------------------------------

def clean_title(col: Column | str) -> Column:
    """Null -> ""; tab and newline -> space; nothing else changes."""
    return F.translate(F.coalesce(_c(col), F.lit("")), "\t\n", "  ")


def title_query(col: Column | str) -> Column:
    """Stripped title, or ``"article"`` when empty or null."""
    t = strip_ws(_c(col))
    return F.when(t.isNull() | (t == F.lit("")), F.lit(DEFAULT_TITLE_QUERY)) \
        .otherwise(t)


def first_line_title(col: Column | str) -> Column:
    """Title for a corpus without a title column: the whole first line."""
    return F.substring_index(_c(col), "\n", 1)


# -- F1 ---------------------------------------------------------------------

def gather_query(words: Column | str) -> Column:
    """Join an array of words with single spaces."""
    return F.array_join(_c(words), " ")


# -- F6 / F7 ----------------------------------------------------------------

def fold_text(col: Column | str) -> Column:
    """ASCII lower-case, fold Latin accents to their base letter, map Unicode
    dashes/quotes/NBSP, drop combining marks; everything else unchanged. ASCII text (as many bytes as
    characters) is only lower-cased, without a look-up for each character."""
    c = _c(col)
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _FOLD_FROM, _FOLD_TO))


def basic_tokens(col: Column | str) -> Column:
    """Words and single punctuation marks of already folded text."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), 1)


def tokenize(col: Column | str) -> Column:
    """``basic_tokens(fold_text(col))``."""
    return basic_tokens(fold_text(col))


def flushes(col: Column | str) -> Column:
    """Tokens of already folded text as they are flushed together: a word, a punctuation mark, or a word
    with the mark right after it."""
    return F.regexp_extract_all(_c(col), F.lit(FLUSH_PATTERN), 1)
