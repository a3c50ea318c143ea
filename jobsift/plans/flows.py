"""Whole flows built from the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift import constants as K
from jobsift.functions import scores
from jobsift.functions.text import non_empty, normalize_job_url
from jobsift.operators import changes, history, ingest, matching, scoring, usage
from jobsift.session import materialize
from jobsift.skew import hot_keys, spread_join


SCORER_INPUTS = ["batch_id", "seq", "jd_text", "job_url", "resume", "hard_reject_filters"]


def _hot_users(jds: DataFrame) -> DataFrame:
    """Counted before the blank filter, so that the count reads ids and no text."""
    return hot_keys(jds, ["user_id"])


def screen_batches(
    jds: DataFrame, profiles: DataFrame, known_locations: Sequence[str],
    period: str = "month", quota: bool = False,
) -> DataFrame:
    """From entered JDs to result rows: blank filter, quota, one profile join, native scoring.

    JDs carry created_at and required_skills.  With ``quota`` the free-tier gate
    counts every scored item of the period as a success.
    """
    items = ingest.drop_blank(jds, "jd_text").withColumn("job_url", normalize_job_url(F.col("job_url")))
    owned = matching.with_profile(
        items, matching.prepare_profiles(profiles, "tier"), ["rules", "profile_skills", "tier"],
        hot=_hot_users(jds))
    if quota:
        gate = usage.quota_gate(
            owned.select(F.col("id").alias("item_id"), "user_id", "tier",
                         F.col("created_at").alias("ts"), F.lit(True).alias("success")),
            period=period)
        owned = owned.join(gate.where("admitted").select(F.col("item_id").alias("id")), "id", "left_semi")
    return matching.score_joined(owned.drop("tier"), known_locations)


def screen_with(
    jds: DataFrame, profiles: DataFrame, scorer: Callable, answer_schema: str,
    period: str = "month", quota: bool = False,
) -> DataFrame:
    """The same flow around a caller's scorer (see ``matching.score_with``).

    ``scorer`` gets batch_id, seq, jd_text, job_url, resume and hard_reject_filters
    and answers with the columns of ``answer_schema``: batch_id, seq, id, job_title,
    company, jd_text, the scores, verdict, hard_reject_reasons, and status,
    detail_items, detail, error, status_text.  A batch ends before its first fatal
    answer, and under ``quota`` a free user's items end with the period's allowance;
    what comes after either is not asked.
    """
    items = ingest.drop_blank(jds, "jd_text").withColumn("job_url", normalize_job_url(F.col("job_url")))
    owners = profiles.withColumn("resume", matching.resume_for_scoring())
    owned = matching.with_profile(
        items, owners, ["resume", "hard_reject_filters", "tier"], hot=_hot_users(jds))
    items_left = F.when(F.lit(quota) & (F.col("tier") == "free"), K.FREE_SCREENS_PER_MONTH)
    asked = owned.withColumns({"ts": F.col("created_at"), "period": F.date_trunc(period, "created_at"), "left": items_left})
    # The steps below read the answers several times; each item is scored once.
    scored = scoring.ask_in_order(asked, scorer, answer_schema, SCORER_INPUTS)
    kept = matching.until_fatal(matching.classify_outcome(scored))
    inputs = items.select("batch_id", "seq", "user_id", "job_url", "job_title", "company", "jd_text")
    return matching.assemble_results(inputs, kept, how="inner")


class Screening(NamedTuple):
    """What a run of screening leaves behind."""

    #: Result rows.
    results: DataFrame
    #: ``(id, user_id, batch_id, reason)`` of the items without a result.
    refused: DataFrame
    #: ``(batch_id, seq, type, message)`` of the answer that ended a batch.
    fatal: DataFrame
    #: ``(user_id, period, used)``: successes to add to the counters, for the next run too.
    usage: DataFrame


def _screenable(jds: DataFrame, profiles: DataFrame) -> DataFrame:
    """Items that can be screened: with a batch, a text and an owner who has a key."""
    asked = ingest.drop_blank(jds, "jd_text").where(non_empty(F.col("batch_id")).isNotNull())
    return asked.withColumn("job_url", normalize_job_url(F.col("job_url")))


def _not_answered(owned: DataFrame, answered: DataFrame, keys: Sequence[str], reason: Column) -> DataFrame:
    return owned.join(answered.select(*keys), list(keys), "left_anti").select("id", "user_id", "batch_id", reason.alias("reason"))


def run_screening(
    jds: DataFrame, profiles: DataFrame, known_locations: Sequence[str], period: str = "month", used_before: DataFrame | None = None,
) -> Screening:
    """A whole run with the native scorer: refusals, quota with what was used before, results, increments.

    ``used_before`` (user_id, period, used) is what earlier runs returned as ``usage``, or the
    stored counters.  Every scored item is a success.  Refused are items without batch, profile,
    key or text, in this order, and those ``over quota``.
    """
    owned = materialize(matching.with_profile(
        _screenable(jds, profiles), matching.prepare_profiles(matching.with_key(profiles), "tier"),
        ["rules", "profile_skills", "tier"], hot=_hot_users(jds)), "owned")
    gate = materialize(usage.quota_gate(
        owned.select(F.col("id").alias("item_id"), "user_id", "tier", F.col("created_at").alias("ts"), F.lit(True).alias("success")),
        period=period, used_before=used_before).where("admitted").select(F.col("item_id").alias("id"), "user_id", "ts", "success"), "admitted")
    results = matching.score_joined(owned.join(gate.select("id"), "id", "left_semi").drop("tier"), known_locations)
    refused = matching.refused_items(jds, profiles).union(_not_answered(owned, gate, ["id"], F.lit("over quota")))
    none = jds.sparkSession.createDataFrame([], "batch_id string, seq long, type string, message string")
    return Screening(results, refused, none, usage.monthly_usage(gate, period))


def run_screening_with(
    jds: DataFrame, profiles: DataFrame, scorer: Callable, answer_schema: str, period: str = "month", used_before: DataFrame | None = None,
) -> Screening:
    """The same run around a caller's scorer (see :func:`screen_with`), which is asked no item in vain.

    Behind an answer that ends a batch items are refused as ``stopped``; the item of that
    answer is in ``fatal``.  Only successes count as used.
    """
    owners = matching.with_key(profiles).withColumn("resume", matching.resume_for_scoring())
    owned = matching.with_profile(_screenable(jds, profiles), owners, ["resume", "hard_reject_filters", "tier"], hot=_hot_users(jds))
    owned = owned.withColumns({"ts": F.col("created_at"), "period": F.date_trunc(period, "created_at")})
    used = (usage.used_in(used_before, period) if used_before is not None
            else owned.select("user_id", "period", F.lit(0).cast("long").alias("_used")).limit(0))
    owned = spread_join(owned, used, ["user_id", "period"], "left", ["id"]).withColumn(
        "left", F.when(F.col("tier") == "free", K.FREE_SCREENS_PER_MONTH - F.coalesce("_used", F.lit(0)))).drop("_used")
    owned = materialize(owned, "owned")
    answers = matching.classify_outcome(scoring.ask_in_order(owned, scorer, answer_schema, SCORER_INPUTS))
    kept = matching.until_fatal(answers)
    inputs = owned.select("batch_id", "seq", "user_id", "job_url", "job_title", "company", "jd_text")
    fatal = matching.fatal_errors(answers)
    ends = fatal.select("batch_id", F.col("seq").alias("_end"))
    rest = spread_join(owned.select("id", "user_id", "batch_id", "seq"), ends, ["batch_id"], "left", ["id"])
    reason = F.when(F.col("seq") > F.col("_end"), "stopped").otherwise("over quota")
    refused = matching.refused_items(jds, profiles).union(_not_answered(rest, answers, ["batch_id", "seq"], reason))
    done = kept.where("outcome = 'ok'").select("batch_id", "seq", F.lit(True).alias("success")).join(
        owned.select("batch_id", "seq", "user_id", "ts"), ["batch_id", "seq"])
    return Screening(matching.assemble_results(inputs, kept, how="inner"), refused, fatal, usage.monthly_usage(done, period))


def ranked_report(results: DataFrame) -> DataFrame:
    """Ranked rows of every batch with label, reason and the batch's counts and time saved."""
    rows = history.rank_results(results, attach=history.verdict_counts(results))
    return rows.select(
        "batch_id", "position", "id", "job_title", "company", "composite_score", "verdict",
        scores.verdict_label(F.col("verdict")).alias("label"),
        scores.reason_line(
            F.col("verdict"), F.col("hard_reject_reasons"), F.col("headline"), F.col("recommendation")
        ).alias("reason"),
        "worth_a_look", F.col("reject").alias("rejects"),
        scores.time_saved(F.col("reject")).alias("saved"),
    )


def history_page(
    results: DataFrame, tracker: DataFrame, verdict: str = "ALL", query: str = "",
    n: int = 200, oldest: bool = False,
) -> DataFrame:
    """Newest rows per user with the tracked flag, filtered and ordered by batch."""
    recent = history.recent_history(results, n)
    shown = history.filter_history(changes.with_tracked_flag(recent, tracker), verdict, query)
    at = recent.groupBy("user_id", "batch_id").agg(F.max("created_at").alias("batch_at"))
    rows = shown.join(at, ["user_id", "batch_id"])
    when = F.asc("batch_at") if oldest else F.desc("batch_at")
    return rows.orderBy("user_id", when, "batch_id", F.desc("created_at"), "id")


def report_page(headers: DataFrame, frozen: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """Live reports with owner name and summary."""
    live = changes.live_reports(headers, now)
    # Rows of expired reports go before they are counted.
    shown = spread_join(frozen.select("id", "slug", "verdict"), live.select("slug"), ["slug"], "left_semi", spread_by=["id"])
    return changes.report_with_owner(live, profiles).join(changes.report_summary(shown), "slug")
