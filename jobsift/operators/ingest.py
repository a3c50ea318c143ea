"""From pasted lists, texts and HTML pages to one row per item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift import constants as K
from jobsift.functions.text import is_blank, js_trim, non_empty, query_param, split_lines, text_problem
from jobsift.skew import keep_top_k

SPACE = r"[ \t\n\x0B\f\r]"
HIDDEN_MARKUP = r"(?is)<!--.*?-->|<script[ >].*?</script>|<style[ >].*?</style>"
HREF = rf"(?is)<a{SPACE}(?:[^>]*?{SPACE})?href{SPACE}*={SPACE}*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
URL_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*:)//([^/?#]*)([^?#]*)([^#]*)"


def explode_url_list(df: DataFrame, col: str, name: str = "url") -> DataFrame:
    """One row per trimmed non-empty line of ``col``; ``seq`` is its position from 0."""
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.posexplode(split_lines(F.col(col))).alias("seq", name))


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    return df.where(~is_blank(F.col(col)))


def cap_batch(df: DataFrame, n: int, keys: Sequence[str] = ("batch_id",), seq: str = "seq") -> DataFrame:
    """The first ``n`` items of each batch."""
    return keep_top_k(df, keys, [(seq, True)], n, row_key=[*keys, seq])


def validate_text(df: DataFrame, col: str, max_chars: int = K.MAX_TEXT_CHARS) -> DataFrame:
    """Trim ``col`` and add ``problem``: why the text is refused, or null."""
    return df.withColumn("problem", text_problem(F.col(col), max_chars)).withColumn(
        col, js_trim(F.col(col)))


def hrefs(html: Column) -> Column:
    """Link targets in document order; comments, scripts and styles do not count."""
    quoted = F.regexp_extract_all(F.regexp_replace(html, HIDDEN_MARKUP, ""), F.lit(HREF), F.lit(1))
    return F.transform(quoted, lambda h: F.replace(
        F.regexp_replace(h, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&")))


def _without_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` of an absolute path."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        # The first, empty part stands for the root and is never removed.
        .when(part == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done))
        .otherwise(F.concat(done, F.array(part))),
    )
    slash = F.when(last.isin(".", ".."), "/").otherwise("")
    return F.when(
        path.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), slash)
    ).otherwise(path)


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on page ``base``; ``href`` itself when base is no URL."""
    scheme, host, path, query = (F.regexp_extract(base, URL_PARTS, i) for i in range(1, 5))
    origin = F.concat(scheme, F.lit("//"), host)
    target = js_trim(href)
    target_path = F.regexp_extract(target, r"^([^?#]*)", 1)
    tail = F.regexp_replace(target, r"^[^?#]*", "")
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (
        F.when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), target)
        .when(scheme == "", target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(origin, _without_dot_segments(target_path), tail))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .when((target == "") | target.startswith("#"), F.concat(origin, path, query, target))
        .otherwise(F.concat(
            origin, _without_dot_segments(F.concat(folder, target_path)), tail))
    )


def is_job_link(url: Column, patterns: Sequence[str] = K.JOB_LINK_PATTERNS) -> Column:
    any_pattern = "(?i)(?:" + "|".join(patterns) + ")"
    return ~url.startswith("#") & ~url.rlike("(?i)^mailto:") & url.rlike(any_pattern)


def extract_job_links(
    pages: DataFrame, patterns: Sequence[str] = K.JOB_LINK_PATTERNS
) -> DataFrame:
    """(page_id, seq, url): the distinct job links of each page, first seen first.

    All work is inside the row, so there is no shuffle.
    """
    links = F.transform(hrefs(F.col("html")), lambda h: resolve_link(F.col("url"), h))
    wanted = F.array_distinct(F.filter(links, lambda u: is_job_link(u, patterns)))
    return pages.select("page_id", F.posexplode(wanted).alias("seq", "job_url"))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(
        tag, rf"(?i){SPACE}{name}{SPACE}*={SPACE}*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return non_empty(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def _tags_with(html: Column, attributes: str) -> Column:
    return F.regexp_extract_all(
        html, F.lit(rf"(?i)<[a-z][^>]*{SPACE}(?:{attributes}){SPACE}*=[^>]*>"), F.lit(0))


def extract_posting_ids(pages: DataFrame, cap: int = K.MAX_POSTING_IDS) -> DataFrame:
    """(page_id, seq, posting_id, url): the first ``cap`` distinct posting ids of each page."""
    html = F.regexp_replace("html", HIDDEN_MARKUP, "")
    by_id = F.transform(
        _tags_with(html, "data-job-id|data-occludable-job-id"),
        lambda t: F.coalesce(_attribute(t, "data-job-id"), _attribute(t, "data-occludable-job-id")),
    )
    by_id = F.filter(by_id, lambda v: v.rlike(r"^\d{5,}\z"))
    by_urn = F.transform(
        _tags_with(html, "data-occludable-entity-urn|data-entity-urn"),
        lambda t: F.regexp_extract(
            F.coalesce(_attribute(t, "data-occludable-entity-urn"), _attribute(t, "data-entity-urn")),
            r"jobPosting:(\d+)", 1),
    )
    by_link = F.transform(hrefs(F.col("html")), lambda h: F.coalesce(
        non_empty(F.regexp_extract(h, r"/jobs/view/(\d+)", 1)),
        F.regexp_extract(h, r"[?&]currentJobId=(\d+)", 1),
    ))
    own = F.array(F.regexp_extract(
        F.coalesce(query_param(F.col("url"), "currentJobId"), F.lit("")), r"^(\d+)\z", 1))
    found = F.filter(F.concat(by_id, by_urn, by_link, own), lambda v: v != "")
    ids = F.slice(F.array_distinct(found), 1, cap)
    return pages.select("page_id", F.posexplode(ids).alias("seq", "posting_id")).withColumn(
        "job_url", F.format_string(K.POSTING_URL, "posting_id"))
