"""WARC derivatives: each response becomes a metadata record (JSON: envelope, headers, digests,
title, links) and a conversion record (plain text).

Both refer to the response (``WARC-Refers-To``), keep its URI and date, and carry digests of
their own block; the metadata record also holds the response's headers and digests. Record
ids are UUIDs derived from the response's id and the record type, so a rerun or a retried
task makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

DATE = "2024-01-01T00:00:00Z"       # of responses whose table has no date
END = "\r\n\r\n"

SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
BREAK = re.compile(r"<(?:/?(?:address|article|aside|blockquote|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|"
                   r"header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|thead|tr|ul)\b[^>]*|br\b[^>]*)>", re.I)
ANY_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
TITLE = re.compile(r"<title[^>]*>([^<]*)", re.I)
VALUE = r"(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"      # quoted or not
LINK = re.compile(r"<(a|link|img|script|iframe)(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?<=[\s\"'/])(href|src)\s*=\s*" + VALUE,
                  re.I)
META = re.compile(r"<meta\b([^>]*)>", re.I)
PAIR = re.compile(r"([a-zA-Z:_-]+)\s*=\s*" + VALUE)

FIELDS = ("record_id string, warc_type string, refers_to string, target_uri string, date string, "
          "content_type string, payload_digest string, block_digest string, content_length long, "
          "header string, block string")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """Visible text, one line for each block."""
    page = SKIPPED.sub(" ", page)
    page = ANY_TAG.sub("", BREAK.sub("\n", page.replace("\n", " ").replace("\r", " ")))
    lines = (" ".join(line.split()) for line in entities.unescape(page).split("\n"))
    return "\n".join(line for line in lines if line)


def http_headers(head: str) -> tuple[str, dict[str, str]]:
    """(status line, headers) of an HTTP message's head; repeated names are joined by a comma."""
    lines = [x for x in (head or "").split("\r\n") if x]
    found: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        name, value = name.strip(), value.strip()
        found[name] = f"{found[name]}, {value}" if name in found else value
    return (lines[0] if lines else ""), found


def derived_id(response: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{response} {kind}')}>"


def _metadata(response: str, uri: str | None, head: str, payload: bytes, page: str) -> str:
    status, headers = http_headers(head)
    title = TITLE.search(page)
    links = [{"path": f"{m[1].upper()}@/{m[2].lower()}", "url": entities.unescape(m[3] or m[4] or m[5] or "")}
             for m in LINK.finditer(page)]
    metas = [{k.lower(): entities.unescape(a or b or c) for k, a, b, c in PAIR.findall(m[1])} for m in META.finditer(page)]
    return json.dumps({"Envelope": {
        "WARC-Header-Metadata": {"WARC-Type": "response", "WARC-Record-ID": response, "WARC-Target-URI": uri},
        "Payload-Metadata": {
            "Actual-Content-Length": len(payload), "Payload-Digest": digest(payload),
            "Block-Digest": digest((head or "").encode() + payload),
            "HTTP-Response-Metadata": {
                "Response-Message": status, "Headers": headers,
                "HTML-Metadata": {"Head": {"Title": " ".join(entities.unescape(title[1]).split()) if title else None,
                                           "Metas": metas}, "Links": links}}}}},
        ensure_ascii=False, separators=(",", ":"))


def _header(fields: list[tuple[str, object]]) -> str:
    clean = ((k, re.sub(r"[\r\n]+", " ", str(v))) for k, v in fields if v is not None)
    return "WARC/1.0\r\n" + "\r\n".join(f"{k}: {v}" for k, v in clean)


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FIELDS.split(", ")]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        sources = []
        cols = [batch.column(c).to_pylist() for c in ("response_id", "target_uri", "date", "http_head", "payload")]
        for i, (response, uri, date, head, page) in enumerate(zip(*cols)):
            page, head = page or "", head or ""
            payload = page.encode("utf-8", "replace")
            for kind, content, text in (
                    ("metadata", "application/json", _metadata(response, uri, head, payload, page)),
                    ("conversion", "text/plain", plain_text(page))):
                block = text.encode("utf-8", "replace")
                rid, mark = derived_id(response, kind), digest(block)
                header = _header([
                    ("WARC-Type", kind), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Record-ID", rid),
                    ("WARC-Refers-To", response), ("WARC-Block-Digest", mark), ("Content-Type", content),
                    ("Content-Length", len(block))])
                for out, value in zip(rows, (rid, kind, response, uri, date, content, digest(payload), mark,
                                             len(block), header, text)):
                    out.append(value)
                sources.append(i)
        lead = [i for i, n in enumerate(batch.schema.names) if n.startswith("_id")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i).take(pa.array(sources, pa.int64())) for i in lead]
            + [pa.array(r, pa.int64() if n == "content_length" else pa.string()) for r, n in zip(rows, names)],
            names=[batch.schema.names[i] for i in lead] + names)


def derivatives(responses: DataFrame, id: str | None = None) -> DataFrame:
    """Two records for each response. ``responses``: (response_id, target_uri, date, http_head,
    payload); ``id``: a column to carry along.

    A null payload or head counts as empty (the records are made all the same); null URIs
    and dates leave their header out. Repeated responses give repeated records. An
    empty table gives an empty result.
    """
    cols = [F.col(c).cast("string").alias(c) for c in ("response_id", "target_uri", "date", "http_head", "payload")]
    lead = [F.col(id).alias("_id")] if id else []
    kind = dict(responses.dtypes)[id] if id else ""
    out = responses.select(*lead, *cols).transform(map_batches, _derive, (f"_id {kind}, " if id else "") + FIELDS)
    return out.withColumnRenamed("_id", id) if id else out


def responses_of(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
                 date: str = DATE) -> DataFrame:
    """Pages as responses of a crawl, each with an id, a date and an HTTP head."""
    h = F.md5(F.concat_ws("\n", F.col(id).cast("string"), F.col(url), F.xxhash64(html).cast("string")))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    length = F.octet_length(F.coalesce(F.col(html), F.lit(""))).cast("string")
    return pages.select(
        F.col(id).alias("page_id"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">")).alias("response_id"),
        F.col(url).alias("target_uri"), F.lit(date).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length,
                 F.lit(END)).alias("http_head"),
        F.col(html).alias("payload"))


def record(header: Column, block: Column) -> Column:
    """A record without the two line ends that close it."""
    return F.concat(header, F.lit(END), block)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One WARC file for each partition: Spark's text sink, whose line separator closes a record."""
    (records.select(record(F.col("header"), F.col("block")).alias("value")).write.mode("overwrite")
     .option("lineSep", END).option("compression", compression).text(path))


def parse_warc(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file's bytes."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = data[end + 4:end + 4 + int(head["Content-Length"])]
        out.append((head, block))
        at = end + 4 + len(block) + 4
    return out


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return derivatives(responses_of(table(spark, sf_dir, "pages")), "page_id")
