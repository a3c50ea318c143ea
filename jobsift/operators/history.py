"""Reading back screening results: filters, rollups, duplicates and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift import constants as K
from jobsift.functions.scores import time_saved, verdict_rank
from jobsift.functions.text import js_trim
from jobsift.skew import keep_top_k, position_in_group, spread_join

BIG_GROUP_SPAN = 1_000_000   # positions per bucket when a group is numbered


def history_match(verdict: str, query: str) -> Column:
    """Whether a row passes the verdict and search filters; null fields never match."""
    passes = F.lit(True) if verdict == "ALL" else F.col("verdict") == verdict
    wanted = js_trim(F.lower(F.lit(query)))
    found = (
        F.coalesce(F.contains(F.lower("company"), wanted), F.lit(False))
        | F.coalesce(F.contains(F.lower("job_title"), wanted), F.lit(False))
    )
    return passes & ((wanted == "") | found)


def filter_history(df: DataFrame, verdict: str = "ALL", query: str = "") -> DataFrame:
    return df.where(history_match(verdict, query))


def recent_history(df: DataFrame, n: int = K.HISTORY_ROWS_PER_USER) -> DataFrame:
    """The newest ``n`` rows of each user, without the job text."""
    return keep_top_k(
        df.drop("jd_text"), ["user_id"], [("created_at", False), ("id", True)], n, row_key=["id"])


def split_results(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored non-rejects, error rows, scored rejects)."""
    sections = with_section(df)
    return tuple(sections.where(F.col("section") == s).drop("section") for s in (0, 1, 2))


def with_section(df: DataFrame) -> DataFrame:
    """Add ``section``: 0 scored non-reject, 1 error (empty id), 2 scored reject."""
    return df.withColumn("section", F.when(F.col("id") == "", 1)
                         .when(F.col("verdict") == "REJECT", 2).otherwise(0))


def _sort_value(key: str) -> tuple[Column, bool]:
    """Sort expression and whether it ascends."""
    if key == "verdict":
        return verdict_rank(F.col("verdict")), True
    if key not in ("composite_score", "ats_score", "role_level_score"):
        raise ValueError(f"cannot sort results by {key}")
    return F.col(key), False


def sort_results(df: DataFrame, key: str = "composite_score") -> DataFrame:
    """All batches in order, each best first.  Sorting on the full key range-partitions
    the rows, so one large batch is spread over several tasks."""
    value, ascending = _sort_value(key)
    return df.orderBy("batch_id", value.asc() if ascending else value.desc(), "seq")


def rank_results(
    df: DataFrame, key: str = "composite_score", attach: DataFrame | None = None
) -> DataFrame:
    """Add each row's ``position`` (from 1) in its batch under :func:`sort_results` order.

    ``attach`` may give further columns per batch_id.
    """
    value, ascending = _sort_value(key)
    return position_in_group(
        df, ["batch_id"],
        [("_value", value, ascending),
         ("_span", F.floor(F.col("seq") / BIG_GROUP_SPAN), True)],
        [F.col("seq").asc()],
        attach=attach,
    )


def section_results(df: DataFrame, key: str = "composite_score") -> DataFrame:
    """Sorted non-rejects, then error rows as entered, then sorted rejects."""
    value, ascending = _sort_value(key)
    within = F.when(F.col("section") == 1, F.lit(None)).otherwise(value)
    return with_section(df).orderBy(
        "batch_id", "section", within.asc() if ascending else within.desc(), "seq")


def batch_totals(history: DataFrame) -> DataFrame:
    """Per user and batch: newest time and number of rows."""
    return history.groupBy("user_id", "batch_id").agg(
        F.max("created_at").alias("batch_at"), F.count("*").alias("rows"))


def batch_rollup(df: DataFrame, n: int = K.HISTORY_ROWS_PER_USER) -> DataFrame:
    """Batches of each user's newest ``n`` rows, with their rows newest first.

    The row limit comes before the grouping, so the oldest batch may be short and
    no list holds more than ``n`` rows.
    """
    history = recent_history(df, n)
    row = F.struct(*[c for c in history.columns if c not in ("user_id", "batch_id")])
    newest_first = F.transform(
        F.array_sort(
            F.collect_list(F.struct("created_at", "id", row.alias("row"))),
            lambda a, b: F.when(a["created_at"] > b["created_at"], -1)
            .when(a["created_at"] < b["created_at"], 1)
            .when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0),
        ),
        lambda x: x["row"],
    )
    return history.groupBy("user_id", "batch_id").agg(
        F.max("created_at").alias("batch_at"), F.count("*").alias("rows"),
        newest_first.alias("results"))


def order_batches(batches: DataFrame, oldest: bool = False) -> DataFrame:
    when = F.col("batch_at").asc() if oldest else F.col("batch_at").desc()
    return batches.orderBy("user_id", when, "batch_id")


def verdict_counts(
    df: DataFrame, keys: tuple[str, ...] = ("batch_id",), more: Sequence[Column] = ()
) -> DataFrame:
    """Rows per verdict and the non-rejects, with ``more`` aggregates; error rows
    (empty id) do not count."""
    scored = F.col("id") != ""
    counts = [
        F.count_if(scored & (F.col("verdict") == v)).alias(v.lower()) for v in K.VERDICTS
    ]
    return df.groupBy(*keys).agg(
        *counts, F.count_if(scored & (F.col("verdict") != "REJECT")).alias("worth_a_look"), *more)


def lifetime_saved(df: DataFrame) -> DataFrame:
    """Per user with at least one reject: rejects ever and time saved."""
    return (
        df.where(F.col("verdict") == "REJECT").groupBy("user_id")
        .agg(F.count("*").alias("rejects"))
        .withColumn("saved", time_saved(F.col("rejects")))
    )


def history_tallies(df: DataFrame, verdict: str = "ALL", query: str = "") -> DataFrame:
    """Per user: rows passing the filters, all rows, batches with a passing row.

    Batches are counted in two steps, each combined before its shuffle.
    """
    by_batch = df.groupBy("user_id", "batch_id").agg(
        F.count_if(history_match(verdict, query)).alias("shown"), F.count("*").alias("rows"))
    return by_batch.groupBy("user_id").agg(
        F.sum("shown").alias("filtered_rows"), F.sum("rows").alias("total_rows"),
        F.count_if(F.col("shown") > 0).alias("batches_left"))


def flag_duplicates(
    df: DataFrame, keys: tuple[str, ...] = ("user_id", "company", "job_title")
) -> DataFrame:
    """Add ``is_duplicate``: true for all but the newest row of each key.

    Null parts of a key are equal to each other.  The newest row is found with
    an aggregate, not by ordering the group.
    """
    marks = [f"_k{i}" for i in range(len(keys))]
    marked = df
    for mark, key in zip(marks, keys):
        marked = marked.withColumn(mark, F.struct(F.col(key).alias("v")))
    # Newest wins; of equally new rows the smallest id.
    newest = (
        marked.groupBy(*marks, "created_at").agg(F.min("id").alias("_keep"))
        .groupBy(*marks).agg(F.max_by("_keep", "created_at").alias("_keep"))
    )
    return spread_join(marked, newest, marks, "inner", spread_by=["id"]).withColumn(
        "is_duplicate", F.col("id") != F.col("_keep")).drop("_keep", *marks)


def tracker_list(tracker: DataFrame) -> DataFrame:
    """Each user's tracked jobs, last touched first."""
    return tracker.orderBy("user_id", F.desc("updated_at"), "id")
