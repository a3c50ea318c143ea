"""Text, list and URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsift import constants as K


def js_trim(c: Column) -> Column:
    """Strip every kind of whitespace from both ends (Spark's trim strips only spaces)."""
    return F.trim(c, F.lit(K.WS_CHARS))


def is_blank(c: Column) -> Column:
    """True for null and for text of whitespace only."""
    return F.coalesce(js_trim(c) == "", F.lit(True))


def non_empty(c: Column) -> Column:
    """Null for the empty string, else the value."""
    return F.nullif(c, F.lit(""))


def split_lines(c: Column) -> Column:
    """Trimmed non-empty lines, in order."""
    return F.filter(F.transform(F.split(c, "\n"), js_trim), lambda x: x != "")


def count_valid_urls(c: Column) -> Column:
    """How many lines look like a URL: start with http, or start like ``word.word``."""
    return F.coalesce(
        F.size(F.filter(
            split_lines(c), lambda x: x.startswith("http") | x.rlike(r"^[\w-]+\.\w+")
        )),
        F.lit(0),
    )


def query_param(url: Column, name: str) -> Column:
    """First value of a query parameter, decoded; null when the URL does not have it.

    A pattern, because the built-in URL parser refuses characters such as spaces
    that browsers accept.
    """
    pattern = rf"^[^?#]*\?(?:[^#]*?&)?{name}(?:=([^&#]*))?(?:[&#]|\z)"
    value = F.regexp_extract(url, pattern, 1)
    return F.when(url.rlike(pattern), F.coalesce(F.try_url_decode(value), value))


def normalize_job_url(c: Column) -> Column:
    """Rewrite search URLs that carry ``currentJobId`` to the posting's own page."""
    host = F.regexp_extract(F.lower(c), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    job = query_param(c, "currentJobId")
    return F.when(
        host.contains("linkedin.com") & job.isNotNull(),
        F.format_string(K.POSTING_URL, job),
    ).otherwise(c)


def word_count(c: Column) -> Column:
    """Runs of non-whitespace.  Mapping all whitespace to one character first is
    several times faster than splitting on the long character class."""
    spaced = F.translate(c, K.WS_CHARS, " " * len(K.WS_CHARS))
    return F.size(F.array_remove(F.split(spaced, " "), ""))


def text_problem(c: Column, max_chars: int = K.MAX_TEXT_CHARS) -> Column:
    """Why a text is refused, or null when it is fine."""
    text = js_trim(c)
    noise = F.length(text) - F.length(F.regexp_replace(text, K.CONTROL_CHARS, ""))
    return (
        F.when(is_blank(c), K.EMPTY_TEXT)
        .when(noise * 100 > F.length(text) * K.CONTROL_CHAR_PERCENT, K.BINARY_TEXT)
        .when(F.length(text) > max_chars, K.LONG_TEXT)
    )


def parse_list(c: Column) -> Column:
    """Comma list to trimmed non-empty items."""
    return F.filter(F.transform(F.split(c, ","), js_trim), lambda x: x != "")


def join_list(c: Column) -> Column:
    return F.array_join(c, ", ")


def add_tags(tags: Column, new: Column) -> Column:
    """Append trimmed non-empty ``new`` items that are not there yet."""
    added = F.filter(F.transform(new, js_trim), lambda x: x != "")
    kept = F.array_distinct(F.filter(added, lambda x: ~F.array_contains(tags, x)))
    return F.concat(tags, kept)


def clip(c: Column, chars: int) -> Column:
    """Cut at ``chars`` characters and mark the cut with an ellipsis."""
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("…"))).otherwise(c)


def normalize_terms(c: Column) -> Column:
    """Lower-cased terms separated by single spaces, with a space at both ends.

    Letters, digits, ``.``, ``+`` and ``#`` belong to a term, so ``.NET``,
    ``C++``, ``C#`` and ``Node.js`` survive; a full stop that ends a term does not.
    """
    # Single spaces, most of all separators, stay as they are: they are not matched and built anew.
    terms = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}.+# ]+", " ")
    padded = F.concat(F.lit(" "), terms, F.lit(" "))
    return F.regexp_replace(F.regexp_replace(padded, r"[.]+ ", " "), " {2,}", " ")


def strip_code_fence(c: Column) -> Column:
    """Drop one leading and one trailing Markdown fence around model output."""
    opened = F.regexp_replace(c, rf"^```(?:(?i)json)?{K.WS}*", "")
    return js_trim(F.regexp_replace(opened, rf"{K.WS}*```{K.WS}*\z", ""))
