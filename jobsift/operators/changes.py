"""Tracking, change sets, deletes and published snapshots.

Tables are immutable: each operator takes a base and a change set and returns
the new version.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsift import constants as K
from jobsift.functions.profiles import has_items
from jobsift.functions.scores import time_saved
from jobsift.functions.text import non_empty
from jobsift.operators.history import verdict_counts
from jobsift.skew import spread_join

SNAPSHOT_PART_ROWS = 200
SLUG_CHARS = 16


# --- tracker ------------------------------------------------------------------

def with_tracked_flag(results: DataFrame, tracker: DataFrame) -> DataFrame:
    """Add ``tracked``: whether the owner tracks the result."""
    links = (
        tracker.where(F.col("screening_result_id").isNotNull())
        .select("user_id", F.col("screening_result_id").alias("id")).distinct()
        .withColumn("_t", F.lit(True))
    )
    return results.join(links, ["user_id", "id"], "left").withColumn(
        "tracked", F.col("_t").isNotNull()).drop("_t")


def track(requests: DataFrame, tracker: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, existing rows returned instead).

    Requests: request_id, user_id, screening_result_id, job_title, company,
    job_url.  A linked result is tracked once per user, the first request wins;
    a request without a link is always inserted.
    """
    link = non_empty(F.col("screening_result_id"))
    wanted = requests.withColumn("screening_result_id", link)
    linked = wanted.where(F.col("screening_result_id").isNotNull())
    keys = ["user_id", "screening_result_id"]
    rest = [c for c in requests.columns if c not in keys]
    first = linked.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), "request_id").alias("_r")).select(*keys, "_r.*")
    new = first.join(tracker.select(*keys), keys, "left_anti")
    unlinked = wanted.where(F.col("screening_result_id").isNull())
    # (user, result) is unique on both sides, so these joins meet no hot key.
    existing = tracker.join(linked.select(*keys).distinct(), keys, "left_semi")
    inserts = new.unionByName(unlinked).select(
        F.col("request_id").cast("string").alias("id"), *keys, "job_title", "company", "job_url",
        F.lit("Applied").alias("status"), F.lit(None).cast(T.StringType()).alias("notes"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    return inserts, existing


def apply_tracker_updates(tracker: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new tracker, refused updates).

    Updates: update_id, id, user_id, status, notes, has_notes, ts.  Null status
    means unchanged.  A wrong status refuses the whole update, and an update of
    another user's row or of no row changes nothing.  Later updates win field by field.
    """
    legal = F.col("status").isNull() | F.col("status").isin(*K.TRACKER_STATUSES)
    refused = updates.where(~legal)
    order = F.struct("ts", "update_id")
    merged = updates.where(legal).groupBy("id", "user_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("_status"),
        F.max_by(F.struct("notes"), F.when(F.col("has_notes"), order)).alias("_notes"),
        F.max("ts").alias("_ts"),
    )
    new = tracker.join(merged, ["id", "user_id"], "left").withColumns({
        "status": F.coalesce("_status", "status"),
        "notes": F.when(F.col("_notes").isNotNull(), F.col("_notes.notes")).otherwise(F.col("notes")),
        "updated_at": F.coalesce("_ts", "updated_at"),
    }).select(*tracker.columns)
    return new, refused


def apply_tracker_deletes(tracker: DataFrame, deletes: DataFrame) -> DataFrame:
    """Tracker without the deleted rows; a delete needs the owner's id too."""
    return tracker.join(deletes.select("id", "user_id"), ["id", "user_id"], "left_anti")


# --- profiles -----------------------------------------------------------------

PATCH_FIELDS = ("full_name", "resume_text", "hard_reject_filters", "preferences", "api_provider")


def apply_profile_patch(
    profiles: DataFrame, patches: DataFrame, fields: Sequence[str] = PATCH_FIELDS
) -> DataFrame:
    """Profiles after ``patches`` (patch_id, user_id, ts, the fields, has_<field>, api_key_encrypted).

    Only fields flagged present change, and a present null is a legal value; an
    empty key keeps the stored one.  Later patches win field by field.
    """
    order = F.struct("ts", "patch_id")
    key = non_empty(F.col("api_key_encrypted"))
    merged = patches.groupBy(F.col("user_id").alias("id")).agg(
        *[F.max_by(F.struct(f), F.when(F.col(f"has_{f}"), order)).alias(f"_{f}") for f in fields],
        F.max_by(key, F.when(key.isNotNull(), order)).alias("_key"),
        F.max("ts").alias("_ts"),
    )
    changed = {
        f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.{f}")).otherwise(F.col(f)) for f in fields
    }
    return profiles.join(merged, "id", "left").withColumns({
        **changed,
        "api_key_encrypted": F.coalesce("_key", "api_key_encrypted"),
        "updated_at": F.coalesce("_ts", "updated_at"),
    }).select(*profiles.columns)


def overlay_profile(base: DataFrame, parsed: DataFrame) -> DataFrame:
    """Stored profiles with the filled-in fields of ``parsed`` (id, parsed struct) on top.

    Empty lists, empty strings and null sizes keep the stored value.
    """
    joined = base.join(parsed.select("id", "parsed"), "id", "left")

    def over(stored: str, name: str) -> Column:
        new = F.col("parsed")[name]
        if name == "title_floor":
            filled = non_empty(new).isNotNull()
        elif name.endswith("_size"):
            filled = new.isNotNull()
        else:
            filled = has_items(new)
        return F.when(filled, new).otherwise(F.col(stored)[name])

    def document(stored: str, names: Sequence[str]) -> Column:
        doc = F.col(stored)
        for name in names:
            doc = doc.withField(name, over(stored, name))
        return doc

    return joined.withColumns({
        "hard_reject_filters": document("hard_reject_filters", (
            "tech_stack_dealbreakers", "title_floor", "geography_allowed",
            "company_type_excluded", "role_type_excluded")),
        "preferences": document("preferences", (
            "preferred_tech_stack", "target_industries", "min_company_size", "max_company_size")),
    }).select(*base.columns)


def safe_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles without the stored key; ``has_api_key`` says whether there is one."""
    return profiles.withColumn(
        "has_api_key", F.coalesce(F.col("api_key_encrypted") != "", F.lit(False))
    ).drop("api_key_encrypted", "pending_order_id")


def owned_orders(confirmations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Payment confirmations whose order is the one pending on the user's profile."""
    pending = profiles.where(non_empty(F.col("pending_order_id")).isNotNull()).select(
        F.col("id").alias("user_id"), F.col("pending_order_id").alias("order_id"))
    return spread_join(
        confirmations, pending, ["user_id", "order_id"], "left_semi", spread_by=["payment_id"])


# --- deletes ------------------------------------------------------------------

def delete_profiles(
    deleted: DataFrame, profiles: DataFrame, **children: DataFrame
) -> dict[str, DataFrame]:
    """Tables after deleting profiles (id): their rows in every child table go too."""
    gone = deleted.select("id").distinct()
    owners = gone.withColumnRenamed("id", "user_id")
    left = {"profiles": profiles.join(gone, "id", "left_anti")}
    for name, child in children.items():
        left[name] = spread_join(child, owners, ["user_id"], "left_anti", spread_by=["id"])
    return left


def delete_results(
    deleted: DataFrame, results: DataFrame, tracker: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(results, tracker) after deleting results (id): tracker rows stay, their link becomes null."""
    gone = deleted.select("id").distinct()
    links = gone.select(F.col("id").alias("screening_result_id")).withColumn("_gone", F.lit(True))
    # Rows without a link stay as they are and do not meet anywhere.
    linked = spread_join(
        tracker.where("screening_result_id IS NOT NULL"), links, ["screening_result_id"], "left", spread_by=["id"])
    unlinked = linked.withColumn(
        "screening_result_id",
        F.when(F.col("_gone").isNull(), F.col("screening_result_id")),
    ).select(*tracker.columns).unionByName(tracker.where("screening_result_id IS NULL"))
    return results.join(gone, "id", "left_anti"), unlinked


# --- published reports ---------------------------------------------------------

def report_slug(request_id: Column, secret: str, chars: int = SLUG_CHARS) -> Column:
    """URL-safe characters from a keyed hash of the request.

    A rerun gives the same link, and only who has the ``secret`` can tell it from the
    request.  Each character is 6 bits; 16 keep billions of reports apart.
    """
    inner = F.sha2(F.concat(F.lit(f"{secret}|in|"), request_id.cast("string")), 256)
    digest = F.base64(F.unhex(F.sha2(F.concat(F.lit(f"{secret}|out|"), inner), 256)))
    return F.substring(F.translate(digest, "+/", "-_"), 1, chars)


def publish_reports(
    results: DataFrame, requests: DataFrame, now: Column, secret: str, days: int = K.REPORT_EXPIRY_DAYS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report headers, frozen rows, refused requests).

    Requests: request_id, user_id, batch_id.  Frozen rows carry every column of
    the result, the slug and the report's row count (snapshot_rows), one row
    each, so a batch of any size fits.
    A request for an empty or another user's batch is refused.  A request may bring its own
    random ``slug``; else the link comes from ``secret`` (see ``report_slug``).
    """
    keys = ["user_id", "batch_id"]
    known = results.groupBy(*keys).agg(F.count("*").alias("rows"))
    headers = requests.join(known, keys).select(
        F.col("request_id").cast("string").alias("id"), *keys,
        F.coalesce(F.col("slug") if "slug" in requests.columns else F.lit(None).cast("string"),
                   report_slug(F.col("request_id"), secret)).alias("slug"), F.col("rows").alias("snapshot_rows"),
        (now + F.make_interval(days=F.lit(days))).alias("expires_at"), now.alias("created_at"),
    )
    frozen = spread_join(
        results, headers.select(*keys, "slug", "snapshot_rows"), keys, "inner", spread_by=["id"]
    ).select(*results.columns, "slug", "snapshot_rows")
    return headers, frozen, requests.join(known, keys, "left_anti")


def nest_snapshots(
    headers: DataFrame, frozen: DataFrame, part_rows: int = SNAPSHOT_PART_ROWS
) -> DataFrame:
    """Reports with nested snapshots; a large report becomes several rows (``part``).

    The parts are even by hash, so about ``part_rows`` rows meet in one list.
    """
    parts = F.ceil(F.col("snapshot_rows") / part_rows)
    columns = [c for c in frozen.columns if c not in ("slug", "snapshot_rows")]
    nested = (
        frozen.withColumn("part", F.pmod(F.xxhash64("id"), parts)).groupBy("slug", "part")
        .agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("results_snapshot"))
    )
    return nested.join(headers.drop("snapshot_rows"), "slug")


def flatten_snapshots(reports: DataFrame) -> DataFrame:
    """Nested snapshots back to one row per frozen result."""
    return reports.select("slug", F.explode("results_snapshot").alias("_r")).select("slug", "_r.*")


def live_reports(reports: DataFrame, now: Column | datetime, slugs: DataFrame | None = None) -> DataFrame:
    """Reports that expire strictly after ``now``, optionally only the given slugs."""
    moment = now if isinstance(now, Column) else F.lit(now)
    live = reports.where(F.col("expires_at") > moment)
    return live if slugs is None else live.join(slugs.select("slug").distinct(), "slug", "left_semi")


def report_with_owner(reports: DataFrame, profiles: DataFrame) -> DataFrame:
    """Reports with the owner's name, null when there is no such profile."""
    names = profiles.select(F.col("id").alias("user_id"), "full_name")
    return spread_join(reports, names, ["user_id"], "left", spread_by=["slug"])


def report_summary(frozen: DataFrame) -> DataFrame:
    """Per slug: verdict counts, rows, and the headline on time saved."""
    counts = verdict_counts(frozen, ("slug",), more=[F.count("*").alias("roles")])
    return counts.withColumn("headline", F.when(F.col("reject") > 0, time_saved(F.col("reject"))).otherwise(
        F.format_string(
            "None of the %d jobs broke a rule.", "roles")))
