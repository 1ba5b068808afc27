"""WARC derivatives: metadata and plain-text conversion records for response records.

A response is a row (record_id, target_uri, date, http_headers, payload).  Each gives one ``metadata``
record (what the response was: source headers, payload digest, title, links) and one ``conversion``
record (its plain text), both naming the response in WARC-Refers-To.  All is declared with SQL
functions, one row in and two out, with no exchange.

Defined cases: a null url becomes an empty target, a null payload an empty one (its digest is that of
no bytes); repeated rows give repeated records; an empty table gives none; other columns are ignored.
Reading takes records apart at the version line, so files are splittable; a record whose block is not
as long as its Content-Length is returned with complete = false and not repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
CRLF = "\r\n"
#: The element names that break a line, and the named entities that are decoded.
BREAKING = ("p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "article", "section", "nav", "header", "footer", "title", "head", "body", "html", "blockquote", "pre")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
#: Patterns in order, each with what takes the place of its matches; they mean the same to Java and RE2.
STRIP = (
    (r"[ \t\n\f\r\x0B]+", " "),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script[^>]*>.*?</script[^>]*>", " "),
    (r"(?is)<style[^>]*>.*?</style[^>]*>", " "),
    (r"(?i)</?(?:" + "|".join(BREAKING) + r")(?:[ \t\n\f\r/][^>]*)?>", "\n"),
    (r"<[^>]*>", ""),
)
TIDY = ((r"[ \t\f\r\x0B]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+\z", ""))
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LINK = r"(?i)<a [^>]*href=\"([^\"]*)\""


def plain_text(html: Column) -> Column:
    """The text of a page: no comments, scripts, styles or tags; one line for each block."""
    out = F.coalesce(html, F.lit(""))
    for pattern, put in STRIP:
        out = F.regexp_replace(out, pattern, put)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    for pattern, put in TIDY:
        out = F.regexp_replace(out, pattern, put)
    return out


def record_urn(kind: str, *parts: Column) -> Column:
    """A name-based urn:uuid in angle brackets."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", http_headers: str = "HTTP/1.1 200 OK\r\nContent-Type: text/html") -> DataFrame:
    """Response records for a table (page_id, url, html) that came without its capture headers."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    return pages.select("page_id", record_urn("response", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), url).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), F.lit(http_headers).alias("http_headers"), html.alias("payload"))


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two linked records for each response; ``keep`` names columns to carry along.

    Returns the kept columns and record_type, record_id, refers_to, target_uri, date, content_type,
    source_headers, source_digest, block_digest, block_bytes, block.
    """
    nl = F.lit(CRLF)
    base = responses.select(
        *keep, F.col("record_id").alias("refers_to"), F.coalesce("target_uri", F.lit("")).alias("target_uri"), "date",
        F.coalesce("http_headers", F.lit("")).alias("source_headers"), F.coalesce("payload", F.lit("")).alias("_payload"),
    ).withColumn("source_digest", digest(F.col("_payload")))
    title = F.regexp_replace(F.regexp_extract("_payload", TITLE, 1), r"[ \t\n\f\r]+", " ")
    links = F.regexp_extract_all("_payload", F.lit(LINK), F.lit(1))
    fields = F.concat(
        F.lit("source-digest: "), F.col("source_digest"), nl,
        F.lit("source-bytes: "), F.octet_length("_payload").cast("string"), nl,
        F.lit("title: "), title, nl,
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), x, nl)), ""),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("_payload")).alias("block")),
    )
    out = base.select(*keep, "refers_to", "target_uri", "date", "source_headers", "source_digest", F.explode(made).alias("_r"))
    return out.select(
        *keep, "_r.record_type", record_urn("derived", F.col("_r.record_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "date",
        "_r.content_type", "source_headers", "source_digest", digest(F.col("_r.block")).alias("block_digest"), F.octet_length("_r.block").cast("long").alias("block_bytes"), F.col("_r.block").alias("block"),
    )


def serialize(records: DataFrame) -> DataFrame:
    """One ``value`` per record: its header lines, an empty line and its block."""
    nl = F.lit(CRLF)
    head = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type")]
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit("")), nl) for name, c in head]
    source = F.concat(F.lit("WARC-Source-Payload-Digest: "), F.col("source_digest"), nl)
    length = F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"), nl)
    http = F.concat(F.lit("WARC-Source-Headers: "), F.regexp_replace("source_headers", "[\r\n]+", " | "), nl)
    return records.select(F.concat(F.lit(VERSION), nl, *lines, source, http, length, nl, F.col("block")).alias("value"))


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write WARC files; the writer's separator is the two line ends that close every record."""
    serialize(records).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Read WARC files back: one row per record with its headers as a map and its block."""
    raw = spark.read.option("lineSep", VERSION + CRLF).text(path).where(F.length("value") > 0)
    cut = F.instr("value", CRLF * 2)
    head = F.substring("value", F.lit(1), cut - 1)
    pairs = F.transform(F.split(head, CRLF), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("key"), F.regexp_replace(x, r"(?s)^[^:]*: ?", "").alias("value")))
    parts = raw.select(F.map_from_entries(pairs).alias("headers"), F.substring("value", cut + 4, F.length("value")).alias("_rest"))
    block = F.regexp_replace("_rest", r"\r\n\r\n\z", "")
    return parts.select("headers", block.alias("block"), (F.octet_length(block) == F.col("headers")["Content-Length"].cast("long")).alias("complete"))
