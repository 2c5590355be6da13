"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response record yields one ``metadata`` and one ``conversion`` record.
Both name the response in ``WARC-Refers-To``, carry its target URI, date and
digests, and keep its source headers; ids of derivatives are name-based on the
response's id, so a rerun gives the same records.

Everything is a projection of the response's own row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: The character references that plain text resolves, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
#: Patterns that Java's and RE2's engines read alike.
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>"
BREAKS = r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|td|th|table|article|section|nav|header|footer|body|html|title|blockquote|pre)\b[^>]*>"
TAG = r"<[^>]*>"
BLANKS = r"[ \t\r\x0B\x0C]+"
EDGES = r" ?\n[ \n]*"


def html_to_text(html: Column) -> Column:
    """Visible text: hidden parts and tags dropped, block tags as line breaks, references resolved."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAG, "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(F.regexp_replace(text, BLANKS, " "), EDGES, "\n")
    return F.regexp_replace(text, r"\A[ \n]+|[ \n]+\z", "")


def sha1_digest(body: Column) -> Column:
    """``sha1:`` and the digest in base 32, five bits a character."""
    hexed = F.sha1(body)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32))


def urn(name: Column) -> Column:
    """A name-based id in the form of a UUID (version 5's layout over a SHA-1)."""
    h = F.sha1(name)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``pages`` (page_id, url, html) as WARC response records.

    Columns: page_id, record_id, target_uri, date, http_headers, payload.
    A null url or html counts as empty; a null page_id is named by its content.
    Rows that are equal throughout are one capture stored twice and share ids.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF))
    return pages.select(
        F.col("page_id"),
        urn(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.sha1(html))).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        http.alias("http_headers"),
        html.alias("payload"),
    )


def derive(records: DataFrame) -> DataFrame:
    """Two derivative records for each response of ``records``.

    Columns: page_id, record_type, record_id, refers_to, target_uri, date,
    content_type, source_headers, payload_digest (the response's), block,
    block_digest, content_length, warc_headers.  An empty payload gives an
    empty conversion block with the digest of no bytes; nulls count as empty;
    columns of other names are ignored; no rows give no rows.
    """
    named = lambda c: F.coalesce(F.col(c), F.lit(""))
    base = records.select(
        "page_id",
        F.col("record_id").alias("refers_to"),
        named("target_uri").alias("target_uri"),
        named("date").alias("date"),
        named("http_headers").alias("source_headers"),
        sha1_digest(named("payload")).alias("payload_digest"),
        F.octet_length(named("payload")).cast("long").alias("payload_length"),
        html_to_text(F.col("payload")).alias("plain"),
        F.regexp_extract(named("payload"), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1).alias("title"),
        F.regexp_extract(named("payload"), r"(?i)<html\b[^>]*\blang=[\"']?([A-Za-z-]+)", 1).alias("language"),
    )
    fields = F.concat(
        F.lit("payload-digest: "), F.col("payload_digest"), F.lit(f"{CRLF}payload-length: "), F.col("payload_length").cast("string"),
        F.lit(f"{CRLF}language: "), F.col("language"), F.lit(f"{CRLF}title: "), F.regexp_replace("title", r"[\r\n]+", " "), F.lit(CRLF), F.col("source_headers"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("plain").alias("block")),
    )
    rows = base.select("page_id", "refers_to", "target_uri", "date", "source_headers", "payload_digest", F.inline(kinds))
    rows = rows.withColumns({"record_id": urn(F.concat_ws("|", "record_type", "refers_to")), "block_digest": sha1_digest(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    return rows.withColumn("warc_headers", header)


def write_warc(derived: DataFrame, path: str) -> None:
    """Write the records as gzipped text files, one for each partition, each record followed by two blank lines."""
    records = derived.select(F.concat("warc_headers", F.lit(CRLF), "block").alias("value"))
    records.write.option("compression", "gzip").option("lineSep", CRLF + CRLF).text(path)
