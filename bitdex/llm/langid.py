"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a text's language, multiplied as odds:

* *text*: naive Bayes over hashed letter trigrams. Counts by declared language over all
  rows (a table of fixed size: languages x ``BUCKETS``); a background class, "und", has
  every trigram alike. The text's log-likelihood is tempered, since neighbouring trigrams
  aren't independent.
* *declared*: the markup's language, right with probability ``TRUST``.
* *address suffix*: the language shares of all rows with that suffix.
* *host*: the language shares of the host's rows, smoothed towards those of its suffix,
  which are smoothed towards those of the corpus (grouped sums of the text posteriors).

"und" stands for text that looks like none of the languages. Rows whose best language is
"und", or that have no letter at all, are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches, row_key, table

BUCKETS = 4096
TEMPER = 0.3            # share of a text's log-likelihood that counts
MOST = 60.0             # log-odds that text evidence may reach
TRUST = 0.9
KAPPA = 20.0            # rows that a prior weighs against a host's or suffix's own
UND = "und"
UND_PRIOR = 0.01
BACKGROUND = 0.1        # share of the background in every language's trigrams

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
CHUNK = 1 << 20        # bytes of text worked on at a time (or one text)
CELLS = 1 << 21        # likelihoods worked on at a time (or those of one text)
LANGUAGES = 1024       # languages whose counts are fetched at a time


def _trigrams(column: pa.Array, rows: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, letters of each row, row and bucket of each trigram) for chunks of texts, of at most ``rows``."""
    column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    every = column.buffers()[2]
    every = np.frombuffer(every, np.uint8) if every is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        end = min(end, row + rows) if rows else end
        cut = offsets[row:end + 1].astype(np.int64) - offsets[row]
        data = _CLASS[every[offsets[row]:offsets[end]]].astype(np.uint32)
        own = np.repeat(np.arange(end - row), np.diff(cut))
        letters = np.bincount(own[data != 32], minlength=end - row)
        if len(data) >= 3:
            a, b, c = data[:-2], data[1:-1], data[2:]
            code = ((a << np.uint32(16)) | (b << np.uint32(8)) | c) * np.uint32(2654435761)
            # of one text, at most one blank and that not in the middle
            good = (own[:-2] == own[2:]) & (b != 32) & ((a != 32) | (c != 32))
            yield row, letters, own[:-2][good], (code >> np.uint32(20))[good].astype(np.int64)
        else:
            none = np.zeros(0, np.int64)
            yield row, letters, none, none
        row = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, bucket, n) over all rows of a task that declare a language."""
    total: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        declared = batch.column(1).to_pylist()
        for first, letters, own, bucket in _trigrams(batch.column(0)):
            names = declared[first:first + len(letters)]
            known = {x: i for i, x in enumerate(dict.fromkeys(names))}
            which = np.array([known[x] for x in names], np.int64)
            counts = np.bincount(which[own] * BUCKETS + bucket, minlength=len(known) * BUCKETS)
            for x, i in known.items():
                if x is not None:
                    total[x] = total.get(x, 0) + counts[i * BUCKETS:(i + 1) * BUCKETS]
            for x in names:
                if x is not None:
                    rows[x] = rows.get(x, 0) + 1
    for x, counts in total.items():
        got = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x] * (len(got) + 1), pa.string()), pa.array(np.append(got, -1).astype(np.int32)),
             pa.array(np.append(counts[got], rows[x]))], names=["lang", "bucket", "n"])


def _score(weights: np.ndarray):
    """Log-likelihood of each language and of the background, tempered and relative to the best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
            for first, letters, own, bucket in _trigrams(batch.column("_text"), max(1, CELLS // len(weights))):
                like = np.stack([np.bincount(own, w[bucket], len(letters)) for w in weights], 1) * TEMPER
                like = np.maximum(like - like.max(axis=1, keepdims=True), -MOST)
                flat = pa.array(like.ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(first, len(letters)) for i in keep]
                    + [pa.ListArray.from_arrays(pa.array(np.arange(0, like.size + 1, len(weights)), pa.int32()), flat),
                       pa.array(letters.astype(np.int64))],
                    names=[batch.schema.names[i] for i in keep] + ["like", "letters"])
    return run


def declared_code(col: Column) -> Column:
    """'en' of 'en-GB' or 'EN_gb'; null for null and blank."""
    code = F.lower(F.regexp_extract(col, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when(code == "", F.lit(None).cast("string")).otherwise(code)


def markup_code(html: Column) -> Column:
    """The language that a page's html element declares."""
    return declared_code(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1))


def suffix_of(host: Column) -> Column:
    """The last label of a host name; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(host, r"\.([^.]+)\.?$", 1)), F.lit(""))


def train(rows: DataFrame) -> tuple[list[str], np.ndarray, dict[str, int]]:
    """(languages, log weights by language and bucket with the background last, rows by language)
    from all ``rows`` (_text as bytes, declared). Every declared language is learnt: codes of two or
    three letters, at ``BUCKETS`` counts each."""
    counts = rows.select("_text", "declared").transform(map_batches, _count, "lang string, bucket int, n long")
    counts = cut_lineage(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    n_rows = {r["lang"]: r["n"] for r in counts.filter("bucket = -1").collect()}
    langs = sorted(n_rows)
    table_ = np.full((len(langs) + 1, BUCKETS), 0.5)
    for a in range(0, len(langs), LANGUAGES):
        some = counts.filter(F.col("bucket") >= 0).filter(F.col("lang").between(langs[a], langs[a:a + LANGUAGES][-1]))
        got = some.select("lang", "bucket", "n").toArrow().combine_chunks()
        if got.num_rows:
            name = pc.dictionary_encode(got.column("lang")).combine_chunks()
            at = np.searchsorted(langs, name.dictionary.to_pylist())
            table_[at[name.indices.to_numpy()], got.column("bucket").to_numpy()] += got.column("n").to_numpy()
    table_[-1] = 1.0
    table_ /= table_.sum(axis=1, keepdims=True)
    table_ *= 1 - BACKGROUND
    table_ += BACKGROUND / BUCKETS
    return langs, np.log(table_, out=table_), n_rows


def _array(values: Sequence, kind: str) -> Column:
    """An array as one literal, however many values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _normal(logs: Column) -> Column:
    """Log-odds to probabilities, in an array."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", declared: Column | None = None,
             host: Column | None = None, suffix: Column | None = None) -> DataFrame:
    """(doc_id, rk, declared, predicted, posterior, kept, letters) of each row of ``docs``.

    ``declared``, ``host`` and ``suffix`` are columns of evidence; null is no evidence of that kind (and
    a host or suffix of its own for the priors). ``rk`` keys the row by id and text. Null and
    empty texts and texts without letters are rejected as "und". Without any declared language
    there is nothing to learn from, and every row is "und". Repeated rows are judged alike; an
    empty table gives an empty result.
    """
    none = F.lit(None).cast("string")
    rows = docs.select(
        F.col(id).alias("doc_id"), row_key(id, text).alias("rk"), F.col(text).cast("binary").alias("_text"),
        declared_code(declared if declared is not None else none).alias("declared"),
        F.coalesce(host if host is not None else none, F.lit("")).alias("host"),
        F.coalesce(suffix if suffix is not None else none, F.lit("")).alias("suffix"))
    langs, weights, n_rows = train(rows)
    names = [*langs, UND]
    kind = dict(rows.dtypes)["doc_id"]
    scored = cut_lineage(rows.transform(map_batches,
        _score(weights), f"doc_id {kind}, rk long, declared string, host string, suffix string, "
                         "like array<double>, letters long"), "likelihoods")
    every = _array(names, "string")
    base = _array([math.log((1 - UND_PRIOR) / max(1, len(langs))) if x != UND else math.log(UND_PRIOR)
                   for x in names], "double")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)          # noqa: E731
    # shares of languages by text alone, summed over groups
    soft = scored.filter("letters > 0").select(
        "host", "suffix", F.posexplode(_normal(add(F.col("like"), base))).alias("i", "p"))
    sums = cut_lineage(soft.groupBy("host", "suffix", "i").agg(F.sum("p").alias("p")), "hosts")
    total = {r["i"]: r["p"] for r in sums.groupBy("i").agg(F.sum("p").alias("p")).collect()}
    n_all = sum(total.values())
    corpus = [(total.get(i, 0.0) + 1) / (n_all + len(names)) for i in range(len(names))]

    def shares(*keys):
        """(sums of each group in an array ``own``, how to smooth them towards a column)."""
        wide = sums.groupBy(*keys, "i").agg(F.sum("p").alias("p")).groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("own"))
        n = F.aggregate("own", F.lit(0.0), lambda a, y: a + y)
        return wide.withColumn("n", n), lambda p: F.zip_with(
            F.col("own"), p, lambda x, y: (x + KAPPA * y) / (F.col("n") + KAPPA))

    suffixes, smooth = shares("suffix")
    suffixes = suffixes.select("suffix", smooth(_array(corpus, "double")).alias("above"))
    hosts, smooth = shares("host", "suffix")
    hosts = cut_lineage(hosts.join(suffixes, "suffix").select("host", "suffix", smooth(F.col("above")).alias("prior")),
                        "priors")
    prior = F.coalesce(F.transform("prior", lambda p: F.log(p)), _array([math.log(x) for x in corpus], "double"))
    wrong = math.log((1 - TRUST) / max(1, len(names) - 1))
    says = F.when(F.col("declared").isNull(), F.transform(every, lambda x: F.lit(0.0))).otherwise(
        F.transform(every, lambda x: F.when(x == F.col("declared"), math.log(TRUST)).otherwise(wrong)))
    out = scored.join(hosts, ["host", "suffix"], "left").withColumn(
        "post", _normal(add(add(F.col("like"), prior), says)))
    best = F.array_position("post", F.array_max("post")).cast("int") - 1
    return out.select(
        "doc_id", "rk", "declared", F.when(F.col("letters") == 0, UND).otherwise(F.get(every, best)).alias("predicted"),
        F.round(F.when(F.col("letters") == 0, 1.0).otherwise(F.array_max("post")), 9).alias("posterior"),
        "letters").withColumn("kept", F.col("predicted") != UND)


def identify_pages(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``identify`` for web pages: the html element's language, the address suffix and the host
    are evidence, and the text is the page without its tags."""
    from .urls import host_of
    host = host_of(F.col(url))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|title)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    rows = pages.select(F.col(id).alias("doc_id"), bare.alias("text"), host.alias("h"), markup_code(F.col(html)).alias("d"))
    return identify(rows, declared=F.col("d"), host=F.col("h"), suffix=suffix_of(F.col("h")))


def of_documents(docs: DataFrame) -> DataFrame:
    """Evidence of the documents table: ``lang`` is declared, ``source`` is the host."""
    return identify(docs, declared=F.col("lang"), host=F.col("source"), suffix=suffix_of(F.col("source")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    return of_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "declared", "predicted", "posterior", "kept", "letters")
