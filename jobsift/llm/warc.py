"""Derived WARC records: metadata and plain-text conversions of responses.

``responses`` frames web pages as response records; ``derive`` makes two records of each: a
``metadata`` record with the source's headers, title, language and digests, and a
``conversion`` record with the page as plain text.  Both name the response in
``WARC-Refers-To`` and keep its target and date.  Digests are SHA-256 of the bytes.
Only built-in functions are used; every row is worked on alone, so nothing is shuffled.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
SPACE = r"\x20\x09-\x0D"
# What is not text, and what ends a line.
UNSEEN = (
    r"(?is)<!--.*?-->|<script\b.*?</script[^>]*>|<style\b.*?</style[^>]*>|<template\b.*?</template[^>]*>"
    r"|<noscript\b.*?</noscript[^>]*>|<title\b.*?</title[^>]*>")
BREAKS = (
    r"(?i)<(?:/?(?:p|div|article|section|header|footer|main|nav|aside|ul|ol|li|dl|dt|dd|table|tr|h[1-6]|blockquote|pre|form"
    r"|figure|figcaption)|br|hr)(?:[\x20\x09-\x0D/][^>]*)?>")
TAGS = r"<[^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANGUAGE = r"""(?i)<html\b[^>]*?[\x20\x09-\x0D]lang=["']?([A-Za-z-]+)"""
#: Names of character references, those of HTML 4 first.
NAMED = {
    **{n: chr(c) for n, c in html.entities.name2codepoint.items()},
    **{n.removesuffix(";"): sign for n, sign in html.entities.html5.items()}}
#: The names by their first letter, from A to z: a look-up goes through those of one letter only.
LETTERS = [chr(c) for c in range(ord("A"), ord("z") + 1)]
#: Names that also stand without a semicolon, the longest first.
OPEN_NAMES = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
REFERENCE = rf"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{OPEN_NAMES}))"
#: What the numbers 128 to 159 stand for; null where they stand for nothing.
WINDOWS = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered(reference: Column) -> Column:
    """The sign of a decimal or hexadecimal reference; U+FFFD if there is no such sign."""
    digits = F.regexp_replace(reference, "^&#[xX]?0*|;$", "")
    number = F.when(F.length(digits) > 7, 0).when(F.regexp_like(reference, F.lit("^&#[xX]")), F.conv(digits, 16, 10).try_cast("int")).otherwise(digits.try_cast("int"))

    def sign(n: Column) -> Column:
        good = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        code = F.when(good, n).otherwise(0xFFFD)
        return F.when(n.between(128, 159), F.get(F.lit(WINDOWS), n - 128)).otherwise(
            F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return _let(F.coalesce(number, F.lit(0)), sign)


def _named(reference: Column) -> Column:
    """The sign of a named reference; an unknown name stays, but for a name without semicolon at its start."""
    lists = [[n for n in NAMED if n[0] == letter] or ["-"] for letter in LETTERS]
    by_letter = F.array(*(F.map_from_arrays(F.lit(names), F.lit([NAMED.get(n, "") for n in names])) for names in lists))
    signs = F.get(by_letter, F.ascii(F.substring(reference, 2, 1)) - ord(LETTERS[0]))
    start = F.regexp_extract(reference, f"^&({OPEN_NAMES})", 1)
    rest = lambda name: F.substring(reference, F.length(name) + 2, F.length(reference))
    return F.coalesce(
        F.try_element_at(signs, F.regexp_replace(reference, "[&;]", "")),
        _let(start, lambda name: F.when(name != "", F.concat(F.try_element_at(signs, name), rest(name)))), reference)


def _plain(text: Column) -> Column:
    """Character references decoded in one pass; spaces and line ends among them become a space."""
    one = lambda r: F.when(F.substring(r, 2, 1) == "#", _numbered(r)).otherwise(_named(r))
    space = lambda sign: F.when(F.regexp_like(sign, F.lit(r"^[\x09-\x0D\x{A0}]$")), " ").otherwise(sign)
    decoded = lambda t: F.array_join(F.zip_with(
        F.split(t, REFERENCE, -1), F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)),
        lambda gap, r: F.concat(gap, F.when(r.isNull(), "").otherwise(_let(one(r), space)))), "")
    return _let(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def visible_text(html: Column) -> Column:
    """The text of a page: a line per block, spaces collapsed, entities decoded; null stays null."""
    text = F.regexp_replace(html, UNSEEN, " ")
    text = F.regexp_replace(text, f"[{SPACE}]+", " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = _plain(F.regexp_replace(text, TAGS, ""))
    text = F.regexp_replace(text, "[ \n]*\n[ \n]*", "\n")
    return F.regexp_replace(F.regexp_replace(text, " +", " "), "^[ \n]+|[ \n]+$", "")


def page_title(html: Column) -> Column:
    found = F.regexp_replace(F.regexp_replace(F.regexp_extract(html, TITLE, 1), TAGS, ""), f"[{SPACE}]+", " ")
    return F.trim(_plain(found))


def record_id(*parts: Column) -> Column:
    """A repeatable identifier, a UUID made of the MD5 of the parts."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE
) -> DataFrame:
    """Pages as response records: ``(id, record_id, target_uri, warc_date, headers, payload)``.

    ``headers`` are the HTTP status line and fields.  Null addresses and pages count as empty.
    The identifier is made of id, address and payload, so only equal rows share one.
    """
    url, html = (F.coalesce(F.col(c), F.lit("")) for c in (url_col, html_col))
    return pages.select(
        F.col(id_col).alias("id"), url.alias("target_uri"), F.lit(date).alias("warc_date"), html.alias("payload"),
        F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                 F.octet_length(html).cast("string"), F.lit(CRLF)).alias("headers"),
        record_id(F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), url, digest(html)).alias("record_id"))


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response record.

    Gives ``(id, record_type, record_id, refers_to, target_uri, warc_date, content_type, block,
    content_length, block_digest, source_digest)``.  ``block`` is the record's text,
    ``content_length`` its bytes, ``source_digest`` the payload digest of the response.  A response
    without payload gives a conversion record with an empty block.  The metadata block consists of
    fields, the status line among them as ``http-status``.  Repeated responses give
    repeated records with equal ids.  Other columns are dropped; an empty frame gives none.
    """
    payload = F.col("payload")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    wide = source.select("id", "record_id", "target_uri", "warc_date", "headers", payload, digest(payload).alias("source_digest"),
                         visible_text(payload).alias("text"))
    meta = F.concat(
        field("title", page_title(payload)), field("declared-language", F.lower(F.regexp_extract(payload, LANGUAGE, 1))),
        field("source-payload-digest", F.col("source_digest")), field("source-length", F.octet_length(payload).cast("string")),
        field("text-length", F.octet_length("text").cast("string")),
        F.regexp_replace("headers", r"^HTTP/[0-9.]+ ", "http-status: "))
    kinds = F.explode(F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block"))))
    rows = wide.select("id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "source_digest", kinds.alias("r")).select("*", "r.*")
    return rows.select(
        "id", "record_type", record_id(F.col("record_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri",
        "warc_date", "content_type", "block", F.octet_length("block").cast("long").alias("content_length"),
        digest(F.col("block")).alias("block_digest"), "source_digest")


def serialized(records: DataFrame) -> DataFrame:
    """The ``id``, ``record_type`` and ``record``: a whole WARC/1.1 record as bytes, ready to be written."""
    field = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), field("WARC-Type", "record_type"), field("WARC-Record-ID", "record_id"),
        field("WARC-Refers-To", "refers_to"), field("WARC-Target-URI", "target_uri"), field("WARC-Date", "warc_date"),
        field("WARC-Block-Digest", "block_digest"), field("Content-Type", "content_type"),
        field("Content-Length", "content_length"), F.lit(CRLF))
    return records.select("id", "record_type", F.concat(head, F.col("block"), F.lit(CRLF * 2)).cast("binary").alias("record"))
