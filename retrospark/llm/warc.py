"""WARC derivative builder: metadata and plain-text conversion records linked to their responses.

Every page is a response record (HTTP header lines and the HTML as payload).  Each response gives

* a ``metadata`` record (``application/warc-fields``): title, language, outlinks, the source's
  HTTP header lines and its payload digest;
* a ``conversion`` record (``text/plain``): the visible text.

Both carry ``WARC-Refers-To`` (the response's record id), its target URI and date, the payload
digest of the response, and a digest of their own block.  Record ids are name-based (an MD5 of
what they stand for), so a job that runs again, or a lost task, gives the same records.

One narrow pass without a shuffle; everything is a DataFrame expression.  ``record_text`` is the
whole record as it stands in a file; :func:`write_warc` writes part files of such records.

Defined cases: null html is an empty payload with empty text and no title; a null url gives
records without a target URI; rows that repeat give records with the same ids; extra columns are
ignored.  Entities other than those of ``ENTITIES`` stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: (pattern, replacement) that turn HTML into text, in this order.
DROP = (
    r"(?s)<!--.*?-->",
    r"(?is)<script\b.*?</script\s*>",
    r"(?is)<style\b.*?</style\s*>",
    r"(?is)<noscript\b.*?</noscript\s*>",
    r"(?is)<template\b.*?</template\s*>",
)
BREAK = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|aside|main|nav|header|footer|body|html|head|title|blockquote|pre|form)\b[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
LANG = r'(?is)<html\b[^>]*\blang\s*=\s*"([^"]*)"'
LINK = r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'


def _clean(col: Column) -> Column:
    for entity, char in ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    col = F.regexp_replace(col, r"[ \t\r\f\x0B]+", " ")
    col = F.regexp_replace(col, r" ?\n[ \n]*", "\n")
    return F.btrim(col, F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments dropped, block tags as line breaks, blanks collapsed."""
    for pattern in DROP:
        html = F.regexp_replace(html, pattern, "")
    return _clean(F.regexp_replace(F.regexp_replace(html, BREAK, "\n"), r"<[^>]*>", ""))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    pick = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", pick(1, 8), pick(9, 4), pick(13, 4), pick(17, 4), pick(21, 12)))


def _digest(col: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col.cast("binary"), 256))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages (page_id, url, html): ids, headers, payload and its digest."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.col("url").alias("target_uri"), html.alias("payload"), _digest(html).alias("payload_digest"))
    return rows.select(
        "page_id",
        "target_uri",
        F.lit(date).alias("date"),
        _urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("target_uri", F.lit("")), F.col("payload_digest")).alias("response_id"),
        F.concat(F.lit(f"Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string")).alias("source_headers"),
        "payload_digest",
        "payload",
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for every response: metadata and conversion.

    Columns: page_id, record_type, record_id, refers_to, target_uri, date, content_type,
    source_headers, payload_digest, title, n_links, block, block_digest, content_length, record_text.
    """
    made = records.select(
        "*",
        _clean(F.regexp_extract("payload", TITLE, 1)).alias("title"),
        F.regexp_extract("payload", LANG, 1).alias("language"),
        F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)).alias("links"),
        plain_text(F.col("payload")).alias("text"),
    ).drop("payload")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    fields = F.concat(
        field("title", F.replace("title", F.lit("\n"), F.lit(" "))),
        field("language", F.col("language")),
        field("payload-digest", F.col("payload_digest")),
        F.regexp_replace("source_headers", r"(?m)^", "source-"),
        F.lit(CRLF),
        F.array_join(F.transform("links", lambda u: F.concat(F.lit("outlink: "), u, F.lit(" L a/@href" + CRLF))), ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    keep = ["page_id", "target_uri", "date", "response_id", "source_headers", "payload_digest", "title"]
    rows = made.select(*keep, F.size("links").alias("n_links"), F.explode(kinds).alias("k")).select(*keep, "n_links", "k.*")
    rows = rows.select(
        "*",
        _urn(F.col("record_type"), F.col("response_id")).alias("record_id"),
        _digest(F.col("block")).alias("block_digest"),
        F.octet_length("block").cast("bigint").alias("content_length"),
    )
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    text = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("response_id"), F.lit(">"))),
        line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("date")),
        line("WARC-Payload-Digest", F.col("payload_digest")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
        F.lit(CRLF),
        F.col("block"),
    )
    return rows.select(
        "page_id", "record_type", "record_id", F.col("response_id").alias("refers_to"), "target_uri", "date", "content_type", "source_headers",
        "payload_digest", "title", "n_links", "block", "block_digest", "content_length", text.alias("record_text"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write the records as part files of WARC records (each closed by two line ends)."""
    records.select("record_text").write.option("lineSep", CRLF + CRLF).text(path)
