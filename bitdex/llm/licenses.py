"""License scan: ordered signature rules over normalised text, column functions only.

Text is lower-cased (A-Z) and cut into words of letters, digits and characters
beyond ASCII; rules are regular expressions over those words joined by blanks.
A rule is tried only on texts that hold one of its keywords, of which every text it matches
has one. Every match is an
interval of words with the rule's priority; an interval that lies inside one of
higher priority, or inside a longer one of the same, is suppressed. What is left gives the labels.

The four base phrases are rules too; their places are reported whether or not a
longer signature suppresses their label.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed phrases and labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


class Rule(NamedTuple):
    label: str
    priority: int           # of 100; also the confidence
    gates: tuple[str, ...]  # one of these words must be there, for every alternative of the pattern; "gpl*":
                            # the word, or one that begins with it (a version may be glued to a name)
    pattern: str            # over blank-separated words
    base: bool = False


# name: (label, keywords, ways to write the name, versions). A version "2.0" is
# written "2 0" or, where it ends in 0, "2".
VERSIONED = (
    ("gpl", ("general", "gpl*"), "(?:gnu )?(?:general public licen[cs]e|gpl)", ("1.0", "2.0", "3.0")),
    ("lgpl", ("lesser", "library", "lgpl*"), "(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl)", ("2.0", "2.1", "3.0")),
    ("agpl", ("affero", "agpl*"), "(?:gnu )?(?:affero general public licen[cs]e|agpl)", ("1.0", "3.0")),
    ("gfdl", ("documentation", "gfdl*"), "(?:gnu )?(?:free documentation licen[cs]e|gfdl)", ("1.1", "1.2", "1.3")),
    ("apache", ("apache*",), "apache(?: software)?(?: licen[cs]e)?", ("1.0", "1.1", "2.0")),
    ("mpl", ("mozilla", "mpl*"), "(?:mozilla public licen[cs]e|mpl)", ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse", "epl*"), "(?:eclipse public licen[cs]e|epl)", ("1.0", "2.0")),
    ("cddl", ("cddl*", "development"), "(?:common development and distribution licen[cs]e|cddl)", ("1.0", "1.1")),
    ("cpl", ("common", "cpl*"), "(?:common public licen[cs]e|cpl)", ("1.0",)),
    ("eupl", ("eupl*", "european"), "(?:european union public licen[cs]e|eupl)", ("1.0", "1.1", "1.2")),
    ("osl", ("osl*", "open"), "(?:open software licen[cs]e|osl)", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", ("academic", "afl*"), "(?:academic free licen[cs]e|afl)", ("1.2", "2.0", "2.1", "3.0")),
    ("artistic", ("artistic",), "artistic licen[cs]e", ("1.0", "2.0")),
    ("bsl", ("boost", "bsl*"), "(?:boost software licen[cs]e|bsl)", ("1.0",)),
    ("zpl", ("zope", "zpl*"), "(?:zope public licen[cs]e|zpl)", ("1.1", "2.0", "2.1")),
    ("lppl", ("latex", "lppl*"), "(?:latex project public licen[cs]e|lppl)", ("1.0", "1.2", "1.3")),
    ("ofl", ("font", "ofl*"), "(?:sil )?(?:open font licen[cs]e|ofl)", ("1.0", "1.1")),
    ("python", ("python", "psf"), "(?:python(?: software foundation)?|psf) licen[cs]e", ("2.0",)),
    ("php", ("php",), "php licen[cs]e", ("3.0", "3.01")),
    ("ecl", ("educational", "ecl*"), "(?:educational community licen[cs]e|ecl)", ("1.0", "2.0")),
    ("mulan", ("mulan",), "mulan (?:psl|permissive software licen[cs]e)", ("1.0", "2.0")),
    ("cecill", ("cecill*",), "cecill(?: licen[cs]e)?", ("1.0", "1.1", "2.0", "2.1")),
    ("odbl", ("odbl*", "database"), "(?:open database licen[cs]e|odbl)", ("1.0",)),
    ("openssl", ("openssl",), "openssl licen[cs]e", ("1.0", "3.0")),
    ("sspl", ("sspl*", "server"), "(?:server side public licen[cs]e|sspl)", ("1.0",)),
    ("busl", ("business", "busl*"), "(?:business source licen[cs]e|busl)", ("1.1",)),
)
CREATIVE = (      # label part, words of the long form
    ("by", "attribution"),
    ("by-sa", "attribution share ?alike"),
    ("by-nc", "attribution non ?commercial"),
    ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
)
CREATIVE_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
SINGLE = (        # label, keywords, pattern, priority
    ("mit", ("mit",), "(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit(?: licen[cs]e)?", 70),
    ("mit", ("hereby",), "permission is hereby granted free of charge to any person obtaining a copy", 90),
    ("mit", ("expat",), "expat licen[cs]e", 60),
    ("mit-0", ("attribution",), "mit no attribution(?: licen[cs]e)?", 80),
    ("isc", ("isc",), "isc licen[cs]e", 60),
    ("isc", ("hereby",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 90),
    ("bsd-2-clause", ("bsd", "freebsd"), "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd)(?: licen[cs]e)?", 70),
    ("bsd-3-clause", ("bsd",), "(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?", 70),
    ("bsd-4-clause", ("bsd",), "(?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?", 70),
    ("bsd", ("bsd",), "bsd(?: style)? licen[cs]e", 50),
    ("bsd", ("redistribution",), "redistribution and use in source and binary forms with or without modification are permitted", 85),
    ("0bsd", ("bsd", "0bsd"), "(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?", 75),
    ("zlib", ("zlib",), "zlib(?: libpng)? licen[cs]e", 60),
    ("zlib", ("warranty",), "this software is provided as is without any express or implied warranty", 65),
    ("libpng", ("libpng", "png"), "(?:png reference library|libpng) licen[cs]e", 60),
    ("unlicense", ("unlicense", "unencumbered"), "(?:the unlicense|free and unencumbered software released into the public domain)", 85),
    ("wtfpl", ("wtfpl", "fuck"), "(?:wtfpl|do what the fuck you want to public licen[cs]e)", 80),
    ("cc0-1.0", ("cc0", "zero"), "(?:cc0(?: 1 0)?(?: universal)?|creative commons zero(?: v?1 0)?(?: universal)?)", 80),
    ("public-domain", ("domain",), "(?:dedicated to|released into|placed in(?:to)?|in) the public domain", 55),
    ("x11", ("x11",), "x11 licen[cs]e", 60),
    ("curl", ("curl",), "curl licen[cs]e", 60),
    ("postgresql", ("postgresql",), "postgresql licen[cs]e", 60),
    ("ncsa", ("ncsa",), "(?:university of illinois )?(?:open source licen[cs]e )?ncsa(?: open source)? licen[cs]e", 60),
    ("ms-pl", ("microsoft",), "microsoft public licen[cs]e", 65),
    ("ms-rl", ("microsoft",), "microsoft reciprocal licen[cs]e", 65),
    ("vim", ("vim",), "vim licen[cs]e", 60),
    ("ruby", ("ruby",), "ruby licen[cs]e", 60),
    ("perl", ("perl",), "(?:same terms as perl itself|perl licen[cs]e)", 65),
    ("beerware", ("beer", "beerware"), "(?:beerware licen[cs]e|beer ware licen[cs]e)", 70),
    ("w3c", ("w3c",), "w3c software(?: notice and)? licen[cs]e", 60),
    ("unicode", ("unicode",), "unicode licen[cs]e(?: agreement)?", 60),
    ("json", ("good",), "shall be used for good not evil", 85),
    ("upl-1.0", ("universal", "upl"), "(?:universal permissive licen[cs]e|upl)(?: v(?:ersion)? 1 0)?", 65),
    ("gpl-classpath-exception", ("classpath",), "(?:gpl )?(?:with )?(?:the )?classpath exception", 85),
    ("proprietary", ("reserved",), "all rights reserved", 40),
    ("proprietary", ("proprietary",), "proprietary (?:and confidential|licen[cs]e)", 45),
    ("commercial", ("commercial",), "commercial licen[cs]e(?: agreement)?", 45),
    ("unknown-license", ("licensed",), "licensed under the (?:terms of the )?[^ ]+ licen[cs]e", 20),
    ("unknown-spdx", ("spdx",), "spdx licen[cs]e identifier [^ ]+", 15),
)


def _number(version: str) -> str:
    words = version.replace(".", " ")
    return f"(?:{words}|{words[:-2]}(?! [0-9]))" if words.endswith(" 0") else words


def signature_rules() -> tuple[Rule, ...]:
    """The rules, in order: base phrases, then per name, per version and per form."""
    out = [Rule(label, 50, (phrase.split()[0],), phrase, True) for phrase, label in BASE]
    for label, gates, name, versions in VERSIONED:
        out.append(Rule(label, 30, gates, f"{name}(?: agreement)?"))
        out.append(Rule(label, 60, gates, "(?:licensed|released|distributed|available) under "
                                          f"(?:the )?(?:terms of the )?{name}"))
        for v in versions:
            which = f"(?: licen[cs]e)?(?: as published by the free software foundation)?(?: either)? ?v? ?(?:ersion )?{_number(v)}"
            out.append(Rule(f"{label}-{v}", 75, gates, f"{name}{which}"))
            out.append(Rule(f"{label}-{v}-or-later", 85, gates,
                            f"{name}{which} (?:of the licen[cs]e )?or (?:at your option )?any later(?: version)?"))
            out.append(Rule(f"{label}-{v}-only", 85, gates, f"{name}{which} only"))
            out.append(Rule(f"{label}-{v}", 95, ("spdx",),
                            f"spdx licen[cs]e identifier {label} {_number(v)}"))
    for part, words in CREATIVE:
        short = part.replace("-", " ")
        long = f"creative commons {words}"
        name = f"(?:{long}|cc {short})"
        label = f"cc-{part}"
        gates = ("creative", "cc")
        out.append(Rule(label, 60 + 2 * len(part), gates, f"{name}(?: licen[cs]e)?"))
        for v in CREATIVE_VERSIONS:
            number = v.replace(".", " ")
            out.append(Rule(f"{label}-{v}", 75 + 2 * len(part), gates,
                            f"{name}(?: licen[cs]e)?(?: v(?:ersion)?)? {number}"
                            "(?: (?:international|unported|generic))?(?: licen[cs]e)?"))
    out += [Rule(label, priority, gates, pattern) for label, gates, pattern, priority in SINGLE]
    return tuple(out)


RULES = signature_rules()


def _literal(rules: Sequence[Rule]) -> Column:
    return F.array(*[F.struct(
        F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"),
        F.array(*[F.lit(g.rstrip("*")) for g in r.gates]).alias("gates"),
        F.lit(f" (?:{r.pattern})(?= )").alias("pattern"), F.lit(r.base).alias("base"))
        for i, r in enumerate(rules)])


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " ", ""))


RUN = 128                    # elements whose results are gathered in one array at a time


def _running(items: Column, state: Column, step, emit, kind: str) -> Column:
    """``emit(state, x)`` of each element in turn, where ``step(state, x)`` is the next state. Results are
    gathered by runs of elements, so the work grows with their number, not its square."""
    def one(acc, x):
        return F.struct(step(acc["s"], x).alias("s"), F.concat(acc["v"], F.array(emit(acc["s"], x))).alias("v"))

    def run(acc, b):
        part = F.aggregate(F.slice(items, b * RUN + 1, F.lit(RUN)),
                           F.struct(acc["s"].alias("s"), F.array().cast(f"array<{kind}>").alias("v")), one)
        return F.element_at(F.transform(F.array(part), lambda r: F.struct(      # once
            r["s"].alias("s"), F.concat(acc["v"], F.array(r["v"])).alias("v"))), 1)

    runs = F.sequence(F.lit(0), ((F.size(items) - 1) / RUN).cast("int"))
    start = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("v"))
    return F.when(F.size(items) > 0, F.aggregate(runs, start, run, lambda acc: F.flatten(acc["v"]))).otherwise(
        F.array().cast(f"array<{kind}>"))


def _matches(words: Column, rule: Column) -> Column:
    """Intervals [start, end) of words, one for each match of ``rule`` in ``words``
    (each word with a blank before it, and one at the end)."""
    found = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    gaps = F.slice(F.split(words, rule["pattern"], F.lit(-1)), F.lit(1), F.size(found))
    lengths = F.zip_with(gaps, found, lambda g, f: F.struct(_blanks(g).alias("g"), _blanks(f).alias("f")))
    return F.element_at(F.transform(F.array(lengths), lambda all_: _running(
        all_, F.lit(0), lambda at, x: at + x["g"] + x["f"],
        lambda at, x: F.struct((at + x["g"]).alias("s"), (at + x["g"] + x["f"]).alias("e")), "struct<s:int,e:int>")), 1)


MATCH = "s:int,e:int,label:string,priority:int,base:boolean"


def _suppressed(found: Column, rules: Sequence[Rule]) -> Column:
    """Matches with ``kept``: false where one of higher priority, or a longer one of the same, contains the
    match. One sweep from left to right, longer ones first: the state is the furthest end so far
    for each priority, of matches that start before this one (``far``) and with it (``here``)."""
    levels = sorted({r.priority for r in rules})
    level = F.array(*[F.lit(p) for p in levels])
    order = F.array_sort(F.transform(found, lambda d: F.struct(
        d["s"].alias("s"), (-d["e"]).alias("_e"), (-d["priority"]).alias("_p"), d.alias("d"))))
    none = F.array_repeat(F.lit(0), len(levels))
    start = F.struct(F.lit(-1).alias("s"), none.alias("far"), none.alias("here"))

    def moved(state, d):
        """The state as the match finds it."""
        new = state["s"] != d["s"]
        return F.struct(d["s"].alias("s"),
                        F.when(new, F.zip_with(state["far"], state["here"], lambda a, b: F.greatest(a, b))).otherwise(state["far"]).alias("far"),
                        F.when(new, none).otherwise(state["here"]).alias("here"))

    def step(state, x):
        d = x["d"]
        return F.element_at(F.transform(F.array(moved(state, d)), lambda m: F.struct(
            m["s"].alias("s"), m["far"].alias("far"),
            F.zip_with(m["here"], level, lambda h, p: F.when(p == d["priority"], F.greatest(h, d["e"])).otherwise(h)).alias("here"))), 1)

    def emit(state, x):
        d = x["d"]

        def inside(m):
            reach = F.zip_with(level, F.zip_with(m["far"], m["here"], lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                               lambda p, r: ((p > d["priority"]) & (F.greatest(r["a"], r["b"]) >= d["e"]))
                               | ((p == d["priority"]) & ((r["a"] >= d["e"]) | (r["b"] > d["e"]))))
            return F.exists(reach, lambda r: r)
        covered = F.element_at(F.transform(F.array(moved(state, d)), inside), 1)
        return F.struct(d["s"].alias("s"), d["e"].alias("e"), d["label"].alias("label"),
                        d["priority"].alias("priority"), d["base"].alias("base"), (~covered).alias("kept"))

    return F.element_at(F.transform(F.array(order), lambda all_: _running(
        all_, start, step, emit, f"struct<{MATCH},kept:boolean>")), 1)


def scan(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with ``_n_words`` and ``_found``: array<struct<s, e, label, priority, base,
    kept>>, the matches in words [s, e), ``kept`` false if suppressed.

    Null and empty texts have no words and no matches; every row is scanned for
    itself, so repeated rows and null ids are alike.
    """
    gates = sorted({g.rstrip("*") for r in rules for g in r.gates})
    names = sorted({g[:-1] for r in rules for g in r.gates if g.endswith("*")})
    table_of_rules = _literal(rules)
    out = docs.withColumn("_norm", F.concat(
        F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.coalesce(F.col(text), F.lit(""))), NOT_WORD, " ")),
        F.lit(" ")))
    out = out.withColumn("_words", F.split(F.trim("_norm"), " "))
    out = out.withColumn("_n_words", F.when(F.col("_norm") == "  ", 0).otherwise(F.size("_words")).cast("long"))
    held = F.col("_words")
    if names:       # what words of the text begin with
        held = F.concat(held, F.regexp_extract_all("_norm", F.lit(f" ({'|'.join(names)})[^ ]"), F.lit(1)))
    out = out.withColumn("_gates", F.array_intersect(held, F.array(*[F.lit(g) for g in gates])))
    found = F.flatten(F.transform(
        F.filter(table_of_rules, lambda r: F.arrays_overlap(r["gates"], F.col("_gates"))),
        lambda r: F.transform(_matches(F.col("_norm"), r), lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), r["label"].alias("label"),
            r["priority"].alias("priority"), r["base"].alias("base")))))
    none = F.array().cast(f"array<struct<{MATCH}>>")
    out = out.withColumn("_all", F.when(F.size("_gates") > 0, found).otherwise(none))
    nothing = F.array().cast(f"array<struct<{MATCH},kept:boolean>>")
    kept = F.when(F.size("_all") > 0, _suppressed(F.col("_all"), rules)).otherwise(nothing)
    return out.withColumn("_found", kept).drop("_norm", "_words", "_gates", "_all")


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The scan as one row for each document."""
    found = scan(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")))
    base = F.filter("_found", lambda d: d["base"])
    kept = F.filter("_found", lambda d: d["kept"])

    def labels(*parts):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(
            *[F.transform(p, lambda d: d["label"]) for p in parts]))), ",")

    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["s"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(base, kept).alias("labels"),
        (F.coalesce(F.array_max(F.transform(kept, lambda d: d["priority"])), F.lit(0)) / 100.0).alias("score"),
        F.size(kept).cast("long").alias("n_kept"), F.size("_found").cast("long").alias("n_found"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license signatures."""
    return report(table(spark, sf_dir, "documents"))
