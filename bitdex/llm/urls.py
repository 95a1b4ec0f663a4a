"""URL filter: rules first, then naive Bayes over words that a Viterbi search cuts host
names and paths into.

1. A unigram model counts words of page titles and texts, over all pages. URLs don't count:
   their runs of letters are what is to be cut. For the same reason a page's own host labels
   and whatever looks like an address don't count in its text. A word of the model has at least
   ``SHORTEST`` letters and ``SEEN`` occurrences, so that chance fragments are none; the listed words
   (below) and those of the rules are in it with a share of ``LISTED`` at least.
2. Each distinct host label or path run of letters is cut into its most probable words
   (unigram Viterbi). A stretch that the model doesn't know costs a word that was never seen, and
   ``LETTER`` for each letter: an unknown name stays whole, unless known words explain it better. The
   substrings of a label meet the model through a join, so the model may be of any size.
3. Multinomial naive Bayes scores the words of host and path of every URL. Its counts: a few
   listed words that are known to be bad or good (``PRIOR`` each), and words of hosts and their paths
   where rules decide *every* URL of the host, and alike (distant labels; a host counts once). A rule
   about some paths of all hosts under a name says nothing of one of those hosts. The
   pseudo-counts of a word are in proportion to the classes, so a word without evidence weighs
   nothing. Words that the rules themselves name (com, en ...) are no evidence, as they made the
   labels, and stay whole; codes of one or two letters are none either. A URL is blocked from
   log-odds of ``BLOCK_FROM`` up.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import lower_ascii, map_batches, table

#: Fixed rules: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Listed words, by verdict.
BAD = ("casino", "poker", "pills", "cheap", "viagra", "spam", "porn", "xxx", "sex", "loan", "loans", "crack",
       "warez", "torrent", "malware", "phishing", "scam", "bet", "bets", "betting", "farm", "clicks", "adult",
       "replica", "ads", "track", "tracker", "tracking")
GOOD = ("news", "docs", "wiki", "university", "school", "library", "science", "health", "history",
        "journal", "museum", "research", "article", "archive")
PRIOR = 100.0         # counts of a listed word
SHORTEST = 3          # letters of a word that is not listed
SEEN = 2              # its occurrences
LISTED = 1e-4         # least share of a listed word among all
LETTER = 2.0          # price of a letter that no word covers
SMOOTH = 5.0          # pseudo-counts of a word
BLOCK_FROM = 2.0


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to / ? # or the end, A-Z lower-cased; empty if none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty if none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def runs(text: Column) -> Column:
    """Runs of letters of a host or path, lower-cased; runs of digits as '#'."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\p{N}+", "#"), F.lit(r"\p{L}+|#"), F.lit(0))


_LETTERS = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|[^>]*>)|&#?\w{1,32};")
_ADDRESS = re.compile(r"\S*(?:://|@|[^\W\d_]\.[^\W\d_])\S*")


def text_words(html: str) -> list[str]:
    """Words of a page's title and text, lower-cased, without addresses."""
    bare = _HIDDEN.sub(" ", html)
    if "://" in bare or "@" in bare or "." in bare:
        bare = " ".join(w for w in bare.split() if not _ADDRESS.fullmatch(w))
    return _LETTERS.findall(bare.lower())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a batch of pages (host, html). A page's own labels don't count on it."""
    for batch in batches:
        total: Counter = Counter()
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = text_words(html or "")
            total.update(words)
            for own in set(_LETTERS.findall(host)):
                if n := words.count(own):
                    total[own] -= n
        total = +total
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                         names=["word", "n"])


def unigrams(pages: DataFrame, url: str, html: str, listed: list[str]) -> DataFrame:
    """(word, n): words of titles and texts, over all pages, without addresses and without the
    labels of the page's own host (a host's name on its own pages doesn't make it a word); the
    ``listed`` ones with ``LISTED`` of all at least."""
    spark = pages.sparkSession
    counts = cut_lineage(
        pages.select(F.lower(host_of(F.col(url))).alias("host"), F.col(html).alias("html"))
        .transform(map_batches, _count_words, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")), "words")
    least = max(1, math.ceil(LISTED * (counts.agg(F.sum("n")).first()[0] or 0)))
    given = spark.createDataFrame([(w, least) for w in sorted(set(listed))], "word string, least long")
    own = counts.filter((F.length("word") >= SHORTEST) & (F.col("n") >= SEEN))
    return own.join(F.broadcast(given), "word", "left_anti").unionByName(
        given.join(counts, "word", "left").select("word", F.greatest("least", F.coalesce("n", F.lit(0))).alias("n")))


def viterbi(label: str, pieces: list[tuple[int, int, int]], total: float) -> list[str]:
    """Most probable cut of ``label``; ``pieces``: (start, length, count) of known words. A stretch
    without a word costs as much as a word seen once, and ``LETTER`` for each letter."""
    unseen = math.log(total)
    known: dict[int, list[tuple[int, float]]] = {}
    for start, length, n in pieces:
        known.setdefault(start, []).append((length, math.log(total) - math.log(n)))
    n = len(label)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)      # cuts that end a word here
    open_, since = [math.inf] * (n + 1), [0] * (n + 1)      # cuts that are in an unknown stretch here
    for i in range(n):
        if open_[i] < best[i]:
            best[i], back[i] = open_[i], since[i]
        for length, cost in known.get(i, ()):
            if best[i] + cost < best[i + length]:
                best[i + length], back[i + length] = best[i] + cost, i
        begun, on = best[i] + unseen + LETTER, open_[i] + LETTER
        open_[i + 1], since[i + 1] = (begun, i) if begun < on else (on, since[i])
    if open_[n] < best[n]:
        back[n] = since[n]
    out, i = [], n
    while i:
        out.append(label[back[i]:i])
        i = back[i]
    return out[::-1]


def _cut(total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [viterbi(run, [(x["s"], x["l"], x["n"]) for x in pieces or ()], total) for run, pieces in
                     zip(batch.column("run").to_pylist(), batch.column("pieces").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(words, pa.list_(pa.string()))],
                                             names=["run", "words"])
    return run


def segment(labels: DataFrame, model: DataFrame) -> DataFrame:
    """(run, words) of each distinct ``run``, cut by the unigram ``model`` (word, n)."""
    size = model.agg(F.sum("n").alias("n"), F.max(F.length("word")).alias("longest")).first()
    total, longest = float((size.n or 0) + 1), size.longest or 1
    at = F.sequence(F.lit(0), F.length("run") - 1)
    starts = labels.select("run", F.explode(at).alias("s"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("s")))
    subs = (starts.select("run", "s", F.explode(lengths).alias("l"))
            .withColumn("word", F.col("run").substr(F.col("s") + 1, F.col("l"))))
    known = (subs.join(model, "word").groupBy("run")
             .agg(F.collect_list(F.struct("s", "l", "n")).alias("pieces")))
    return labels.join(known, "run", "left").select("run", "pieces").transform(map_batches,
        _cut(total), "run string, words array<string>")


def verdicts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
             rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, host_words) of each row; ``score`` is the
    log-odds of block against allow that the method gives, also where a rule decides.

    A null URL or one without ``://`` has an empty host and path; with no evidence the
    verdict is allow. Repeated rows and null ids are judged alike. Empty table: empty result.
    """
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).drop("url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict)
    rows = rows.withColumn("shape", F.array_join(runs(F.col("path")), " "))
    seen = cut_lineage(rows.select("host", "shape", "by_rule").distinct(), "urls")

    named = sorted({w for h, p, _ in rules for w in (h + p).replace("/", ".").split(".") if w})
    model = cut_lineage(unigrams(pages, url, html, [*BAD, *GOOD, *named]), "unigrams")
    parts = (seen.select(F.col("host").alias("text"), F.lit("host").alias("kind")).distinct()
             .unionByName(seen.select(F.col("shape").alias("text"), F.lit("path").alias("kind")).distinct()))
    pieces = parts.select("text", "kind", F.posexplode(runs(F.col("text"))).alias("i", "run"))
    cut = segment(pieces.filter((F.col("run") != "#") & ~F.col("run").isin(named)).select("run").distinct(), model)
    words = cut_lineage(pieces.join(cut, "run", "left").select(
        "text", "kind", "i", F.posexplode(F.coalesce("words", F.array("run"))).alias("j", "word")), "url-words")

    # word counts by verdict, from hosts of which rules decide every URL alike
    sure = (seen.filter("host <> ''").groupBy("host").agg(
        F.count_if(F.col("by_rule").isNull()).alias("open"), F.min("by_rule").alias("lo"), F.max("by_rule").alias("hi"))
        .filter("open = 0 AND lo = hi").select("host", F.col("lo").alias("sure")))
    sure = cut_lineage(sure, "sure-hosts")
    evidence = F.length("word") >= SHORTEST
    of_host = sure.join(words.filter((F.col("kind") == "host") & evidence).select(F.col("text").alias("host"), "word"), "host")
    shapes = seen.join(sure, "host").select("host", "sure", "shape").distinct()
    of_path = shapes.join(words.filter((F.col("kind") == "path") & evidence).select(F.col("text").alias("shape"), "word"), "shape")
    prior = pages.sparkSession.createDataFrame(
        [(w, "block", PRIOR) for w in BAD] + [(w, "allow", PRIOR) for w in GOOD], "word string, sure string, n double")
    counts = cut_lineage(
        of_host.select("host", "sure", "word").unionByName(of_path.select("host", "sure", "word")).distinct()
        .select("word", "sure", F.lit(1.0).alias("n")).unionByName(prior).groupBy("word")
        .agg(F.sum(F.when(F.col("sure") == "block", F.col("n")).otherwise(0.0)).alias("block"),
             F.sum(F.when(F.col("sure") == "allow", F.col("n")).otherwise(0.0)).alias("allow")), "url-counts")
    t = counts.agg(F.sum("block").alias("b"), F.sum("allow").alias("a")).first()      # the listed words are in both
    share = float(t["b"]) / float(t["b"] + t["a"])
    odds = counts.filter(~F.col("word").isin(named)).select("word", (
        F.log((F.col("block") + SMOOTH * share) / (F.col("allow") + SMOOTH * (1 - share)))
        - math.log(share / (1 - share))).alias("w"))
    scored = cut_lineage(words.join(odds, "word", "left").groupBy("text", "kind").agg(
        F.sum(F.coalesce("w", F.lit(0.0))).alias("w"),
        F.array_sort(F.collect_list(F.struct("i", "j", "word"))).alias("cut")), "url-scores")
    hosts = scored.filter("kind = 'host'").select(
        F.col("text").alias("host"), F.col("w").alias("hw"), F.transform("cut", lambda x: x["word"]).alias("host_words"))
    shapes = scored.filter("kind = 'path'").select(F.col("text").alias("shape"), F.col("w").alias("pw"))
    out = rows.join(hosts, "host", "left").join(shapes, "shape", "left")
    score = F.round(F.coalesce("hw", F.lit(0.0)) + F.coalesce("pw", F.lit(0.0)), 9)
    return out.withColumn("score", score).select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")).alias("verdict"),
        "score", F.array_join(F.coalesce("host_words", F.array().cast("array<string>")), " ").alias("host_words"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    return verdicts(table(spark, sf_dir, "pages"))
