"""One query per operator over the test tables; ``plans/oracle.py`` has the SQL.

Arrays are written out as text and times as text, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsift import constants as K
from jobsift import schemas
from jobsift.functions import profiles as pf
from jobsift.functions import scores, text
from jobsift.operators import access, changes, dictionary, history, ingest, insight, matching, usage
from jobsift.plans import flows
from jobsift.plans import views as v
from jobsift.session import materialize, work_dir
from jobsift.skew import hot_keys
from jobsift.sources import intake, sinks, tables
from jobsift.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = "2024-02-01 12:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def ts(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


def ordered(c: Column | str) -> Column:
    return F.array_join(F.sort_array(c), "|")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


# --- sources and sinks ----------------------------------------------------------

def stored_screenings(df: DataFrame) -> DataFrame:
    """View rows in the stored layout, with the analysis as JSON text."""
    analysis = F.to_json(F.struct(
        "ats_score", "role_level_score", "composite_score", "verdict", "hard_reject_reasons",
        "headline", "recommendation"))
    return df.withColumn("analysis_json", analysis).select(
        *[F.col(f.name).cast(f.dataType) for f in schemas.SCREENING])


@query
def a1_scan_screenings(spark, sf_dir):
    path = work_dir(spark, "screenings")
    stored_screenings(v.screenings(spark, sf_dir)).write.parquet(path)
    return tables.scan_screenings(spark, path).select(
        "id", "user_id", "batch_id", "job_url", "job_title", "company",
        F.length("jd_text").alias("chars"), "composite_score", "verdict",
        joined("hard_reject_reasons").alias("reasons"), ts("created_at").alias("created"))


@query
def a2_scan_profiles(spark, sf_dir):
    path = work_dir(spark, "profiles")
    v.profiles(spark, sf_dir).withColumns({
        c: F.to_json(c) for c in ("hard_reject_filters", "preferences")
    }).select(*[F.col(f.name).cast(f.dataType) for f in schemas.PROFILE]).write.parquet(path)
    return tables.scan_profiles(spark, path).select(
        "id", "email", "full_name", "tier", "screens_used_this_month",
        joined("hard_reject_filters.tech_stack_dealbreakers").alias("tech"),
        F.col("hard_reject_filters.title_floor").alias("floor"),
        joined("preferences.preferred_tech_stack").alias("liked"),
        F.col("preferences.min_company_size").alias("min_size"),
        F.col("preferences.onboarding_completed").alias("onboarded"))


@query
def a3_scan_tracker(spark, sf_dir):
    path = work_dir(spark, "tracker")
    v.tracker(spark, sf_dir).select(
        *[F.col(f.name).cast(f.dataType) for f in schemas.TRACKER]).write.parquet(path)
    return tables.scan_tracker(spark, path).select(
        "id", "user_id", "screening_result_id", "company", "status", "notes",
        ts("created_at").alias("created"), ts("updated_at").alias("updated"))


# Links of test reports only; a service passes a secret of its own.
LINK_SECRET = "test reports"


def numbered(rows: DataFrame, name: str = "place") -> DataFrame:
    """The place of each row of a sorted frame, from 1: partition sizes, then places inside."""
    stored = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftrightunsigned("_at", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return stored.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, place).drop(
        "_at", "_part", "_before")


def _publish(spark, sf_dir):
    results = v.screenings(spark, sf_dir)
    return changes.publish_reports(results, v.batches(spark, sf_dir), now(), LINK_SECRET)


@query
def a4_scan_reports(spark, sf_dir):
    path = work_dir(spark, "reports")
    stored = stored_screenings(v.screenings(spark, sf_dir))
    headers, frozen, _ = changes.publish_reports(stored, v.batches(spark, sf_dir), now(), LINK_SECRET)
    nested = changes.nest_snapshots(headers, frozen)
    nested.select(*[F.col(f.name).cast(f.dataType) for f in schemas.REPORT]).write.parquet(path)
    rows = changes.flatten_snapshots(tables.scan_reports(spark, path))
    return rows.select("batch_id", "id", "job_title", "composite_score", "verdict",
                       F.length("jd_text").alias("chars"))


@query
def a5_decode_analysis(spark, sf_dir):
    rows = stored_screenings(v.screenings(spark, sf_dir))
    n = F.col("id").cast("long")
    mixed = rows.withColumn("analysis_json", F.when(n % 10 == 3, "{}").when(n % 10 == 4, "{broken")
                            .when(n % 10 == 5, F.lit(None)).otherwise(F.col("analysis_json")))
    return tables.decode_analysis(mixed).select(
        "id", "analysis_ok", F.col("analysis.verdict").alias("verdict"),
        F.col("analysis.composite_score").alias("composite"),
        joined("analysis.hard_reject_reasons").alias("reasons"),
        F.length("analysis.headline").alias("headline_chars"))


@query
def a6_parse_model_output(spark, sf_dir):
    n = F.col("id").cast("long")
    doc = F.to_json(F.struct(
        F.col("hard_reject_filters.title_floor"), F.col("preferences.preferred_tech_stack"),
        F.col("preferences.min_company_size")))
    raw = F.when(n % 4 == 0, F.concat(F.lit("```json\n"), doc, F.lit("\n```\n"))).when(
        n % 4 == 1, F.concat(F.lit("``` "), doc, F.lit("```"))).when(
        n % 4 == 2, doc).otherwise(F.concat(F.lit("Here it is: "), doc))
    ok, bad = tables.parse_model_output(v.profiles(spark, sf_dir).select("id", raw.alias("raw")), "raw")
    return ok.select(
        "id", F.lit(True).alias("ok"), F.col("parsed.title_floor").alias("floor"),
        joined("parsed.preferred_tech_stack").alias("liked"),
        F.col("parsed.min_company_size").alias("min_size"),
    ).unionByName(bad.select("id", F.lit(False).alias("ok")), allowMissingColumns=True)


@query
def a7_append_screenings(spark, sf_dir):
    path = work_dir(spark, "appended")
    n = F.col("seq")
    rows = v.screenings(spark, sf_dir).withColumns({
        "verdict": F.when(n % 19 == 0, "MAYBE").otherwise(F.col("verdict")),
        "ats_score": F.when(n % 29 != 0, F.col("ats_score")), "analysis_json": F.lit("{}")})
    refused = sinks.append_screenings(rows, path)
    kept = tables.scan_screenings(spark, path).select("id", "verdict", F.lit("").alias("problems"))
    return kept.unionByName(refused.select("id", "verdict", joined("problems").alias("problems")))


@query
def a8_export_rows(spark, sf_dir):
    return sinks.export_rows(v.screenings(spark, sf_dir)).drop("seq")


@query
def a8_export_batches_csv(spark, sf_dir):
    path = work_dir(spark, "export")
    sinks.export_batches_csv(v.screenings(spark, sf_dir), path, v.batches(spark, sf_dir))
    columns = ", ".join(f"`{c}` string" for c in (*K.EXPORT_COLUMNS, "batch_id"))
    read = spark.read.options(header=True, escape='"', multiLine=True).schema(columns).csv(path)
    return read.select("batch_id", *[F.coalesce(c, F.lit("")).alias(c) for c in K.EXPORT_COLUMNS])


@query
def a8_export_all_csv(spark, sf_dir):
    path = work_dir(spark, "export")
    sinks.export_all_csv(v.screenings(spark, sf_dir), path)
    read = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    return read.select(F.col("Batch").alias("batch_id"), F.col("Place").cast("long").alias("place"),
                       *[F.coalesce(c, F.lit("")).alias(c) for c in K.EXPORT_COLUMNS])


@query
def a7_append_runs(spark, sf_dir):
    """Two runs that share half of their rows, each of them tried twice."""
    path = work_dir(spark, "runs")
    # The columns of the table, and what tells the runs apart.
    rows = v.screenings(spark, sf_dir).withColumn("analysis_json", F.lit("{}")).select("seq", *schemas.SCREENING.names)
    n = F.col("seq")
    for run, part in (("a", n % 3 != 2), ("b", n % 3 != 0)):
        for _ in range(2):
            refused = sinks.append_run(rows.where(part), path, run)
    kept = sinks.stored_runs(spark, path, schemas.SCREENING).select("id", "run", F.lit("").alias("problems"))
    return kept.unionByName(refused.select("id", F.lit("b").alias("run"), joined("problems").alias("problems")))


@query
def a8_export_all_crlf(spark, sf_dir):
    path = work_dir(spark, "export")
    sinks.export_all_crlf(v.screenings(spark, sf_dir), path)
    read = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    return read.select(F.col("Batch").alias("batch_id"), F.col("Place").cast("long").alias("place"),
                       *[F.coalesce(c, F.lit("")).alias(c) for c in K.EXPORT_COLUMNS])


@query
def a9_export_ranked_crlf(spark, sf_dir):
    path = work_dir(spark, "ranked")
    sinks.export_ranked_crlf(v.screenings(spark, sf_dir), path)
    read = spark.read.options(header=True, escape='"', multiLine=True).csv(f"{path}/rows")
    return read.select(F.col("Batch").alias("batch_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in K.RANKED_COLUMNS])


@query
def e2_track_runs(spark, sf_dir):
    """Two runs of requests for the same results, each of them tried twice: every result is tracked once."""
    path, n = work_dir(spark, "tracker"), F.col("seq")
    asked = v.screenings(spark, sf_dir).select(
        "seq", n.alias("request_id"), "user_id", F.col("id").alias("screening_result_id"), "job_title", "company", "job_url")
    for run, part in (("a", n % 4 != 3), ("b", n % 4 != 0)):
        for _ in range(2):
            sinks.track_run(asked.where(part).drop("seq").withColumn("request_id", F.concat(F.lit(run), F.col("request_id").cast("string"))), path, run, now())
    return sinks.stored_runs(spark, path, schemas.TRACKER).select("id", "user_id", "screening_result_id", "run")


@query
def a9_export_ranked_csv(spark, sf_dir):
    path = work_dir(spark, "ranked")
    sinks.export_ranked_csv(v.screenings(spark, sf_dir), path)
    columns = ", ".join(f"`{c}` string" for c in (*K.RANKED_COLUMNS, "batch_id"))
    read = spark.read.options(header=True, escape='"', multiLine=True).schema(columns).csv(f"{path}/rows")
    return read.select("batch_id", *[F.coalesce(c, F.lit("")).alias(c) for c in K.RANKED_COLUMNS])


@query
def a9_ranked_rows(spark, sf_dir):
    return sinks.ranked_rows(v.screenings(spark, sf_dir))


@query
def a9_time_saved_summary(spark, sf_dir):
    return sinks.time_saved_summary(v.screenings(spark, sf_dir))


@query
def a10_intake_documents(spark, sf_dir):
    n = F.col("doc_id")
    name = F.concat(F.lit("/in/d"), n.cast("string"), F.when(n % 5 == 0, ".txt").when(
        n % 5 == 1, ".docx").otherwise(".PDF"))
    magic = F.when(n % 5 != 2, "%PDF-1.7\n").otherwise("")
    tail = F.when(n % 10 == 3, "/JS  (x)").when(n % 10 == 4, "/AA<<").otherwise("")
    body = F.encode(F.concat(magic, "text", tail), "UTF-8")
    size = F.when(n % 10 == 8, F.octet_length(body).cast("long") * 10_000).otherwise(
        F.octet_length(body).cast("long"))
    files = v.table(spark, sf_dir, "documents").select(
        name.alias("path"), size.alias("length"), body.alias("content"))
    return intake.check_documents(files)


# --- ingestion ------------------------------------------------------------------

@query
def b1_explode_url_list(spark, sf_dir):
    return ingest.explode_url_list(v.url_lists(spark, sf_dir), "pasted").withColumn(
        "seq", F.col("seq").cast("int"))


@query
def b2_count_valid_urls(spark, sf_dir):
    return v.url_lists(spark, sf_dir).select(
        "batch_id", text.count_valid_urls(F.col("pasted")).alias("valid"))


@query
def b3_drop_blank(spark, sf_dir):
    return ingest.drop_blank(v.noisy_documents(spark, sf_dir), "text").select(
        "doc_id", F.length("text").alias("chars"))


@query
def b4_normalize_job_url(spark, sf_dir):
    items = ingest.explode_url_list(v.url_lists(spark, sf_dir), "pasted")
    return items.select("batch_id", F.col("seq").cast("int").alias("seq"),
                        text.normalize_job_url(F.col("url")).alias("job_url"))


@query
def b5_extract_job_links(spark, sf_dir):
    return ingest.extract_job_links(v.job_pages(spark, sf_dir)).withColumn("seq", F.col("seq").cast("int"))


@query
def b6_extract_posting_ids(spark, sf_dir):
    return ingest.extract_posting_ids(v.job_pages(spark, sf_dir)).withColumn("seq", F.col("seq").cast("int"))


@query
def b7_validate_text(spark, sf_dir):
    return ingest.validate_text(v.noisy_documents(spark, sf_dir), "text").select(
        "doc_id", F.length("text").alias("chars"), "problem")


@query
def b8_word_count(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select(
        "doc_id", text.word_count(F.col("text")).alias("words"))


@query
def b9_lists(spark, sf_dir):
    items = text.parse_list(F.col("list"))
    tags = text.add_tags(items, F.array(F.lit(" new "), F.element_at(F.concat(items, F.array(F.lit(""))), 1),
                                        F.lit(""), F.lit("new")))
    return v.tag_lists(spark, sf_dir).select(
        "doc_id", F.size(items).alias("items"), F.md5(text.join_list(items)).alias("joined"),
        F.size(tags).alias("tags"), F.element_at(tags, -1).alias("last_tag"))


@query
def b10_overlay_profile(spark, sf_dir):
    n = F.col("id").cast("long")
    none = F.array().cast("array<string>")
    parsed = F.struct(
        F.when(n % 2 == 0, F.array(F.lit("Rust"), F.lit("Go"))).otherwise(none).alias("preferred_tech_stack"),
        none.alias("target_industries"),
        F.when(n % 3 == 0, "").otherwise("Lead").alias("title_floor"),
        F.when(n % 5 == 0, F.array(F.lit("Spain"))).alias("geography_allowed"),
        none.alias("tech_stack_dealbreakers"), none.alias("company_type_excluded"),
        F.array(F.lit("night")).alias("role_type_excluded"),
        F.when(n % 2 == 0, F.lit(7)).alias("min_company_size"),
        F.lit(None).cast("int").alias("max_company_size"))
    people = v.profiles(spark, sf_dir)
    over = changes.overlay_profile(people, people.select("id", parsed.alias("parsed")))
    return over.select(
        "id", joined("preferences.preferred_tech_stack").alias("liked"),
        joined("preferences.target_industries").alias("industries"),
        F.col("preferences.min_company_size").alias("min_size"),
        F.col("preferences.max_company_size").alias("max_size"),
        F.col("hard_reject_filters.title_floor").alias("floor"),
        joined("hard_reject_filters.geography_allowed").alias("places"),
        joined("hard_reject_filters.tech_stack_dealbreakers").alias("tech"),
        joined("hard_reject_filters.role_type_excluded").alias("roles"))


@query
def b11_cap_batch(spark, sf_dir):
    items = ingest.explode_url_list(v.url_lists(spark, sf_dir), "pasted")
    texts = v.usage_items(spark, sf_dir).select(
        F.col("user_id").alias("batch_id"), F.col("item_id").alias("seq"))
    return ingest.cap_batch(texts, K.MAX_TEXTS_PER_BATCH).select(
        F.concat(F.lit("u"), "batch_id").alias("batch_id"), "seq"
    ).unionByName(ingest.cap_batch(items, K.MAX_URLS_PER_BATCH).select(
        F.col("batch_id").cast("string").alias("batch_id"), F.col("seq").cast("long").alias("seq")))


# --- predicates -------------------------------------------------------------------

@query
def c1_tenant_scope(spark, sf_dir):
    rows = access.tenant_scope(v.screenings(spark, sf_dir), v.principals(spark, sf_dir))
    return rows.select("id", "user_id")


@query
def c2_filter_history(spark, sf_dir):
    return history.filter_history(v.screenings(spark, sf_dir), "WEAK", " SRC1 ").select(
        "id", "company", "job_title", "verdict")


@query
def c3_live_reports(spark, sf_dir):
    return changes.live_reports(v.reports(spark, sf_dir), now()).select("slug", ts("expires_at").alias("expires"))


@query
def c3_stored_reports(spark, sf_dir):
    """Live reports out of a table written for look-ups by slug."""
    path = work_dir(spark, "headers")
    sinks.store_reports(v.reports(spark, sf_dir), path)
    return changes.live_reports(spark.read.parquet(path), now()).select("slug", ts("expires_at").alias("expires"))


@query
def c4_split_results(spark, sf_dir):
    good, errors, rejects = history.split_results(v.with_error_rows(v.screenings(spark, sf_dir)))
    parts = [p.select("seq", "id", F.lit(name).alias("part")) for name, p in (
        ("good", good), ("error", errors), ("reject", rejects))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def c5_constraint_violations(spark, sf_dir):
    n = F.substring("id", 2, 20).cast("long")
    rows = v.tracker(spark, sf_dir).withColumns({
        "status": F.when(n % 8 == 0, "Hired").when(n % 9 == 0, F.lit(None)).otherwise(F.col("status")),
        "updated_at": F.when(n % 5 != 0, F.col("updated_at"))})
    return access.constraint_violations(rows, access.TRACKER_RULES).select(
        "id", joined("problems").alias("problems"))


def _detection() -> Column:
    n = F.col("seq")
    return F.when(n % 5 != 4, F.struct(
        F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("is_fake_em"),
        F.when(n % 4 == 0, "high").when(n % 4 == 1, "medium").when(n % 4 == 2, "low").alias("confidence")))


@query
def c6_inflated_manager(spark, sf_dir):
    return v.screenings(spark, sf_dir).withColumn("d", _detection()).select(
        "id", scores.inflated_manager(F.col("d")).alias("flagged"))


# --- scoring and scalar columns -----------------------------------------------------

@query
def d1_effective_resume(spark, sf_dir):
    return v.profiles(spark, sf_dir).select("id", matching.resume_for_scoring().alias("resume"))


@query
def d2_composite_score(spark, sf_dir):
    return v.screenings(spark, sf_dir).select(
        "id", "ats_score", "role_level_score",
        scores.composite_score(F.col("ats_score"), F.col("role_level_score")).alias("composite"))


@query
def d3_hard_rejects(spark, sf_dir):
    judged = matching.apply_hard_rejects(
        v.jds(spark, sf_dir), v.profiles(spark, sf_dir), v.KNOWN_LOCATIONS)
    return judged.select("id", joined("hard_reject_reasons").alias("reasons"), "rejected")


def _coverage_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "id", F.size("matching_skills").alias("matching"), F.size("missing_skills").alias("missing"),
        F.md5(ordered("matching_skills")).alias("matching_md5"),
        F.md5(ordered("missing_skills")).alias("missing_md5"), "ats_score")


@query
def d4_ats_coverage(spark, sf_dir):
    return _coverage_columns(matching.ats_coverage(v.jds(spark, sf_dir), v.skilled_profiles(spark, sf_dir)))


@query
def d4_skill_spelling(spark, sf_dir):
    """Skills as the texts spell them, with case twins and nulls in both lists."""
    def spelled(c):
        words = F.filter(F.split(c, "[^A-Za-z]+"), lambda w: F.length(w) >= 2)
        return F.concat(words, F.array(F.lit(None).cast("string")), F.transform(words, lambda w: F.upper(w)))

    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("_text"))
    jds = docs.select("id", F.col("id").alias("user_id"), spelled(F.col("_text")).alias("required_skills"))
    own = docs.select((F.col("id").cast("long") - 1).cast("string").alias("id"), F.lit(None).cast(
        "struct<tech_stack_dealbreakers:array<string>,title_floor:string,geography_allowed:array<string>,"
        "company_type_excluded:array<string>,role_type_excluded:array<string>>").alias("hard_reject_filters"),
        spelled(F.col("_text")).alias("profile_skills"))
    out = matching.ats_coverage(jds, own)
    return out.select(
        "id", F.size("matching_skills").alias("matching"), F.size("missing_skills").alias("missing"),
        F.md5(joined("matching_skills")).alias("matching_md5"), F.md5(joined("missing_skills")).alias("missing_md5"), "ats_score")


def skill_dictionary(spark, sf_dir) -> DataFrame:
    """Terms of one to four words: the first words of each passage, and its last two."""
    words = F.split(F.trim(text.normalize_terms(F.col("text"))), " ")
    parts = F.array(*(F.array_join(F.slice("w", 1, n), " ") for n in (1, 2, 3, 4)), F.array_join(F.slice("w", -2, 2), " "))
    passages = v.table(spark, sf_dir, "benchmark").select(words.alias("w")).where(F.size("w") >= 4)
    return dictionary.prepare_dictionary(passages.select(F.explode(parts).alias("term")))


@query
def d4_skills_in_text(spark, sf_dir):
    """Every term in every whole text, with its place."""
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return dictionary.find_terms(docs, skill_dictionary(spark, sf_dir)).select("id", "place", "words", "term")


@query
def d4_coverage_from_text(spark, sf_dir):
    """Skill coverage where the required skills come out of the job texts."""
    rows = v.jds(spark, sf_dir)
    jds = dictionary.with_required_skills(rows, skill_dictionary(spark, sf_dir))
    # The rows before their texts are searched know the hot users.
    return _coverage_columns(matching.ats_coverage(jds, v.skilled_profiles(spark, sf_dir), hot=hot_keys(rows, ["user_id"])))


@query
def d4_ats_coverage_weighted(spark, sf_dir):
    return matching.ats_coverage(
        v.jds(spark, sf_dir), v.skilled_profiles(spark, sf_dir), v.skill_weights(spark, sf_dir)
    ).select("id", "ats_score")


@query
def d5_role_level_score(spark, sf_dir):
    return matching.role_level_score(v.jds(spark, sf_dir), v.profiles(spark, sf_dir)).select(
        "id", "role_level_score")


@query
def d6_verdict(spark, sf_dir):
    return v.screenings(spark, sf_dir).select("id", "composite_score", "verdict")


@query
def d7_verdict_label(spark, sf_dir):
    shown = F.when(F.col("seq") % 31 == 0, "OTHER").otherwise(F.col("verdict"))
    return v.screenings(spark, sf_dir).select("id", shown.alias("verdict"), scores.verdict_label(shown).alias("label"))


@query
def d8_score_band(spark, sf_dir):
    return v.screenings(spark, sf_dir).select("id", "ats_score", scores.score_band(F.col("ats_score")).alias("band"))


@query
def d9_why_verdict(spark, sf_dir):
    missing = F.slice(F.lit(["a", "b", "c"]), 1, (F.col("seq") % 4).cast("int"))
    return v.screenings(spark, sf_dir).select("id", scores.why_verdict(
        F.col("verdict"), F.col("ats_score"), F.col("role_level_score"),
        missing, F.when(F.col("seq") % 21 != 0, F.col("hard_reject_reasons"))).alias("why"))


@query
def d10_reason_line(spark, sf_dir):
    return v.screenings(spark, sf_dir).select("id", scores.reason_line(
        F.col("verdict"), F.col("hard_reject_reasons"), F.col("headline"), F.col("recommendation")
    ).alias("reason"))


@query
def d11_recommendation_action(spark, sf_dir):
    return v.screenings(spark, sf_dir).select(
        "id", scores.recommendation_action(F.col("recommendation")).alias("action"))


@query
def d12_score_breakdown(spark, sf_dir):
    return v.screenings(spark, sf_dir).select("id", scores.score_breakdown(
        F.col("verdict"), F.col("ats_score"), F.col("role_level_score"), F.col("composite_score")
    ).alias("breakdown"))


@query
def d13_time_saved(spark, sf_dir):
    return v.screenings(spark, sf_dir).select("id", scores.time_saved(F.col("seq") % 40).alias("saved"))


@query
def d14_active_rules(spark, sf_dir):
    return v.profiles(spark, sf_dir).select(
        "id", joined(pf.active_rules(F.col("hard_reject_filters"))).alias("rules"))


@query
def d15_profile_completeness(spark, sf_dir):
    args = (F.col("preferences"), F.col("hard_reject_filters"), F.col("api_key_encrypted"))
    score = pf.completeness(*args)
    return v.profiles(spark, sf_dir).select(
        "id", score.alias("score"), pf.completeness_band(score).alias("band"),
        pf.next_action(*args).alias("next_action"))


@query
def d16_onboarding_flags(spark, sf_dir):
    return v.profiles(spark, sf_dir).select(
        "id", pf.is_new_user(F.col("resume_text"), F.col("api_key_encrypted"), F.col("preferences")).alias("is_new"),
        pf.has_preferences(F.col("preferences"), F.col("hard_reject_filters")).alias("has_preferences"))


@query
def d17_safe_profiles(spark, sf_dir):
    safe = changes.safe_profiles(v.profiles(spark, sf_dir))
    return safe.drop("hard_reject_filters", "preferences", "created_at", "updated_at")


@query
def d18_assemble_results(spark, sf_dir):
    answers = matching.classify_outcome(v.outcomes(spark, sf_dir))
    n = F.col("seq")
    inputs = v.screenings(spark, sf_dir).select(
        "batch_id", "seq", "user_id", "job_url",
        F.when(n % 3 == 0, "typed title").alias("job_title"),
        F.when(n % 4 == 0, F.lit("")).alias("company"),
        F.when(n % 2 == 0, F.lit("typed text")).alias("jd_text"))
    out = matching.assemble_results(inputs, answers)
    return out.select(
        "seq", "id", "user_id", "batch_id", "job_url", "job_title", "company",
        F.length("jd_text").alias("chars"), "ats_score", "role_level_score", "composite_score",
        "verdict", joined("hard_reject_reasons").alias("reasons"))


@query
def d19_classify_outcome(spark, sf_dir):
    return matching.classify_outcome(v.outcomes(spark, sf_dir)).select("seq", "outcome", "message")


# --- joins --------------------------------------------------------------------------

@query
def e1_with_tracked_flag(spark, sf_dir):
    return changes.with_tracked_flag(v.screenings(spark, sf_dir), v.tracker(spark, sf_dir)).select("id", "tracked")


@query
def e2_track(spark, sf_dir):
    inserts, existing = changes.track(v.tracked_requests(spark, sf_dir), v.tracker(spark, sf_dir), now())
    columns = ("id", "user_id", "screening_result_id", "job_title", "status")
    return inserts.select(*columns, F.lit("new").alias("kind")).unionByName(
        existing.select(*columns, F.lit("existing").alias("kind")))


@query
def e3_report_with_owner(spark, sf_dir):
    people = v.profiles(spark, sf_dir)
    left = changes.delete_profiles(people.where("tier = 'paid'").select("id"), people)["profiles"]
    return changes.report_with_owner(v.reports(spark, sf_dir), left).select("slug", "full_name")


@query
def e4_with_profile(spark, sf_dir):
    people = matching.with_key(v.profiles(spark, sf_dir))
    jds = v.jds(spark, sf_dir)
    kept = matching.with_profile(jds, people, ["email", "tier"]).select("id", "email", "tier")
    refused = matching.without_profile(jds, people).select("id")
    return kept.unionByName(refused, allowMissingColumns=True)


def covered(spark, sf_dir, times: DataFrame | None = None) -> DataFrame:
    """Screened JDs with their skill lists, stored as results are before they are studied.

    ``times`` (seq, created_at) join the JDs before their lists are made and move.
    """
    jds = v.jds(spark, sf_dir)
    if times is not None:
        jds = jds.drop("created_at").join(times, "seq")
    rows = matching.ats_coverage(jds, v.skilled_profiles(spark, sf_dir))
    return materialize(rows.select(
        "id", "user_id", "batch_id", "seq", "job_title", "matching_skills", "missing_skills",
        *([] if times is None else ["created_at"])), "covered")


@query
def e5_flag_in_profile(spark, sf_dir):
    rows = covered(spark, sf_dir)
    demand = insight.skill_demand(rows).select("batch_id", F.initcap("skill").alias("skill"), "jds")
    return insight.flag_in_profile(demand, insight.batch_matching_skills(rows))


@query
def e6_owned_orders(spark, sf_dir):
    return changes.owned_orders(v.confirmations(spark, sf_dir), v.profiles(spark, sf_dir))


@query
def e6_confirm_orders(spark, sf_dir):
    owned = changes.owned_orders(v.confirmations(spark, sf_dir), v.profiles(spark, sf_dir))
    return usage.confirm_orders(v.profiles(spark, sf_dir), owned).select("id", "tier", "pending_order_id")


@query
def e7_delete_profiles(spark, sf_dir):
    gone = v.profiles(spark, sf_dir).where("tier = 'paid'").select("id")
    left = changes.delete_profiles(
        gone, v.profiles(spark, sf_dir), results=v.screenings(spark, sf_dir),
        tracker=v.tracker(spark, sf_dir), reports=v.reports(spark, sf_dir))
    parts = [df.select("id", F.lit(name).alias("kind")) for name, df in left.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def e7_delete_results(spark, sf_dir):
    gone = v.screenings(spark, sf_dir).where("verdict = 'REJECT'").select("id")
    results, tracker = changes.delete_results(gone, v.screenings(spark, sf_dir), v.tracker(spark, sf_dir))
    return results.select("id", F.lit(None).cast("string").alias("link"), F.lit("result").alias("kind")).unionByName(
        tracker.select("id", F.col("screening_result_id").alias("link"), F.lit("tracker").alias("kind")))


# --- aggregations -----------------------------------------------------------------

@query
def f1_batch_rollup(spark, sf_dir):
    rolled = history.batch_rollup(v.screenings(spark, sf_dir), n=20)
    return rolled.select("user_id", "batch_id", ts("batch_at").alias("batch_at"), "rows", joined(
        F.transform("results", lambda r: r["id"])).alias("ids"))


@query
def f2_verdict_counts(spark, sf_dir):
    return history.verdict_counts(v.with_error_rows(v.screenings(spark, sf_dir)))


@query
def f3_lifetime_saved(spark, sf_dir):
    return history.lifetime_saved(v.screenings(spark, sf_dir))


@query
def f4_history_tallies(spark, sf_dir):
    return history.history_tallies(v.screenings(spark, sf_dir), "WEAK", "src1")


@query
def f5_skill_demand(spark, sf_dir):
    return insight.skill_demand(covered(spark, sf_dir)).withColumn("rank", F.col("rank").cast("int"))


@query
def f6_top_missing(spark, sf_dir):
    return insight.top_missing(covered(spark, sf_dir))


@query
def f7_batch_matching_skills(spark, sf_dir):
    return insight.batch_matching_skills(covered(spark, sf_dir))


def _dashed() -> Column:
    return F.concat("job_title", F.when(F.col("seq") % 2 == 0, " — Remote").otherwise(""))


@query
def f8_title_patterns(spark, sf_dir):
    rows = v.screenings(spark, sf_dir).withColumn("job_title", _dashed()).withColumn(
        "batch_id", F.col("user_id"))
    return insight.title_patterns(rows)


@query
def f9_red_flag_count(spark, sf_dir):
    return insight.red_flag_count(v.screenings(spark, sf_dir).withColumn("fake_em_detection", _detection()))


@query
def f10_min_batch(spark, sf_dir):
    return insight.min_batch(v.screenings(spark, sf_dir))


@query
def f11_blocking_skills(spark, sf_dir):
    return insight.blocking_skills(covered(spark, sf_dir)).withColumn("blockers", joined("blockers"))


@query
def f12_explode_requirements(spark, sf_dir):
    words = F.slice(F.split("job_title", " "), 1, 2)
    status = F.lit(["met", "partial", "missing", "unclear"])
    items = F.transform(words, lambda w, i: F.struct(
        w.alias("requirement"), F.element_at(status, ((F.col("seq") + i) % 4 + 1).cast("int")).alias("status"),
        F.col("company").alias("evidence")))
    doc = F.to_json(F.struct(items.alias("requirements_met")))
    rows = v.screenings(spark, sf_dir).select("id", F.when(F.col("seq") % 6 != 0, doc).alias("analysis_json"))
    return insight.explode_requirements(tables.decode_analysis(rows)).withColumn("seq", F.col("seq").cast("int"))


@query
def f13_apply_usage(spark, sf_dir):
    return usage.apply_usage(v.profiles(spark, sf_dir), v.usage_items(spark, sf_dir)).select(
        "id", "screens_used_this_month")


@query
def f14_batch_intelligence(spark, sf_dir):
    rows = covered(spark, sf_dir).withColumn("fake_em_detection", _detection()).withColumn("job_title", _dashed())
    out = insight.batch_intelligence(rows)
    return out.select(
        "batch_id", "total_jds", "red_flags_count",
        joined(F.transform("top_required_skills", lambda s: F.concat_ws(
            ":", s["skill"], s["count"].cast("string"), s["trend"]))).alias("required"),
        joined("top_missing_from_profile").alias("missing"), joined("title_patterns").alias("titles"))


@query
def f14_intelligence_lists(spark, sf_dir):
    """The lists of a batch whole, as rows."""
    rows = covered(spark, sf_dir).withColumn("fake_em_detection", _detection()).withColumn("job_title", _dashed())
    return insight.intelligence_lists(rows)


@query
def f6_top_missing_cut(spark, sf_dir):
    return insight.top_missing(covered(spark, sf_dir), k=K.TOP_SKILLS)


@query
def f8_title_patterns_cut(spark, sf_dir):
    rows = v.screenings(spark, sf_dir).withColumn("job_title", _dashed()).withColumn("batch_id", F.col("user_id"))
    return insight.title_patterns(rows, k=5)


@query
def f15_report_summary(spark, sf_dir):
    _, frozen, _ = _publish(spark, sf_dir)
    named = frozen.select("id", "verdict", F.col("batch_id").alias("slug"))
    return changes.report_summary(named)


# --- windows ------------------------------------------------------------------------

@query
def g1_until_fatal(spark, sf_dir):
    items = matching.classify_outcome(v.outcomes(spark, sf_dir)).withColumn("batch_id", F.col("user_id"))
    return matching.until_fatal(items).select("batch_id", "seq", "outcome")


@query
def g2_quota_gate(spark, sf_dir):
    return usage.quota_gate(v.usage_items(spark, sf_dir), period="week").select("item_id", "user_id", "admitted")


@query
def g2_quota_carried(spark, sf_dir):
    """The stored counter stands for what was used in the first week of the data."""
    items = v.usage_items(spark, sf_dir)
    start = items.agg(F.min("ts")).first()[0]
    used = v.profiles(spark, sf_dir).select(
        F.col("id").alias("user_id"), F.col("screens_used_this_month").alias("used"), F.lit(start).alias("period"))
    return usage.quota_gate(items, period="week", used_before=used).select("item_id", "user_id", "admitted")


@query
def g3_flag_duplicates_by_title(spark, sf_dir):
    """With the default key; titles and companies repeat here over all users."""
    rows = v.screenings(spark, sf_dir).withColumn("user_id", F.lit("u"))
    return history.flag_duplicates(rows).select("id", "is_duplicate")


@query
def g3_flag_duplicates(spark, sf_dir):
    return history.flag_duplicates(v.screenings(spark, sf_dir), ("user_id", "company")).select(
        "id", "user_id", "company", "is_duplicate")


@query
def g4_recent_history(spark, sf_dir):
    rows = v.usage_items(spark, sf_dir).select(
        F.col("item_id").cast("string").alias("id"), "user_id", F.col("ts").alias("created_at"))
    return history.recent_history(rows, 50).select("id", "user_id")


# --- sorts --------------------------------------------------------------------------

@query
def h1_rank_results(spark, sf_dir):
    return history.rank_results(v.screenings(spark, sf_dir)).select(
        "batch_id", "id", "composite_score", F.col("position").cast("long").alias("position"))


@query
def h1_sort_results_by_verdict(spark, sf_dir):
    return numbered(history.sort_results(v.screenings(spark, sf_dir), "verdict").select("batch_id", "id", "verdict"))


@query
def h2_section_results(spark, sf_dir):
    return numbered(history.section_results(v.with_error_rows(v.screenings(spark, sf_dir))).select(
        "batch_id", "section", "seq", "id", "composite_score"))


@query
def h3_tracker_list(spark, sf_dir):
    return numbered(history.tracker_list(v.tracker(spark, sf_dir)).select("user_id", "id", ts("updated_at").alias("updated")))


@query
def h4_order_batches(spark, sf_dir):
    totals = history.batch_totals(v.screenings(spark, sf_dir))
    return numbered(history.order_batches(totals, oldest=True).select(
        "user_id", "batch_id", ts("batch_at").alias("batch_at"), "rows"))


# --- change sets --------------------------------------------------------------------

@query
def j1_profile_patch(spark, sf_dir):
    out = changes.apply_profile_patch(
        v.profiles(spark, sf_dir), v.patches(spark, sf_dir),
        fields=("full_name", "resume_text", "api_provider"))
    return out.select("id", "full_name", F.md5("resume_text").alias("resume_md5"), "api_provider",
                      "api_key_encrypted", ts("updated_at").alias("updated"))


@query
def j2_payment_events(spark, sf_dir):
    events = usage.decode_payment_events(v.payments(spark, sf_dir))
    return usage.apply_payment_events(v.profiles(spark, sf_dir), events).select("id", "email", "tier")


@query
def j3_tracker_updates(spark, sf_dir):
    new, refused = changes.apply_tracker_updates(v.tracker(spark, sf_dir), v.tracker_updates(spark, sf_dir))
    return new.select("id", "status", "notes", ts("updated_at").alias("updated")).unionByName(
        refused.select(F.concat(F.lit("refused "), F.col("update_id").cast("string")).alias("id"), "status",
                       F.lit(None).cast("string").alias("notes"), F.lit("").alias("updated")))


@query
def j4_tracker_deletes(spark, sf_dir):
    asked = v.tracker_updates(spark, sf_dir).where("has_notes").select("id", "user_id")
    return changes.apply_tracker_deletes(v.tracker(spark, sf_dir), asked).select("id", "user_id")


@query
def j5_publish_reports(spark, sf_dir):
    headers, frozen, refused = _publish(spark, sf_dir)
    heads = frozen.join(headers.select("slug", "expires_at"), "slug").select(
        "batch_id", "id", "composite_score", "verdict", ts("expires_at").alias("expires"),
        F.length("jd_text").alias("chars"))
    return heads.unionByName(refused.select(
        "batch_id", F.concat(F.lit("refused "), "request_id").alias("id")), allowMissingColumns=True)


@query
def j6_reset_usage(spark, sf_dir):
    return usage.reset_usage(v.profiles(spark, sf_dir)).select("id", "screens_used_this_month")


# --- streams --------------------------------------------------------------------------

@query
def k1_stream_screen(spark, sf_dir):
    arriving, out, state = (work_dir(spark, n) for n in ("jds", "screened", "state"))
    rows = v.jds(spark, sf_dir)
    rows.write.parquet(arriving)
    stream = streams.read_stream(spark, rows.schema, arriving)
    stored = work_dir(spark, "profiles")
    matching.prepare_profiles(v.skilled_profiles(spark, sf_dir)).write.parquet(stored)
    streams.stream_screen(
        stream, spark.read.parquet(stored), v.KNOWN_LOCATIONS, out, state).awaitTermination()
    return spark.read.parquet(out).select(
        "id", "ats_score", "role_level_score", "composite_score", "verdict",
        joined("hard_reject_reasons").alias("reasons"))


@query
def k2_stream_tiers(spark, sf_dir):
    arriving, out, state = (work_dir(spark, n) for n in ("payments", "tiers", "state"))
    rows = v.payments(spark, sf_dir)
    rows.write.parquet(arriving)
    stream = streams.read_stream(spark, rows.schema, arriving)
    streams.update_to(streams.stream_tiers(stream), out, state).awaitTermination()
    latest = streams.read_updates(spark, out, ["email"])
    return usage.apply_tiers(v.profiles(spark, sf_dir), latest).select("id", "email", "tier")


@query
def k3_stream_usage(spark, sf_dir):
    arriving, out, state = (work_dir(spark, n) for n in ("usage", "used", "state"))
    rows = v.usage_items(spark, sf_dir)
    rows.write.parquet(arriving)
    stream = streams.read_stream(spark, rows.schema, arriving)
    streams.update_to(streams.stream_usage(stream), out, state).awaitTermination()
    return streams.read_updates(spark, out, ["user_id", "period"]).select(
        "user_id", ts("period").alias("period"), "used")


@query
def k1_stream_admission(spark, sf_dir):
    """JDs that arrive in three runs, in order of time: together they admit what one run would."""
    arriving, out, state, stored = (work_dir(spark, n) for n in ("jds", "screened", "state", "profiles"))
    rows = v.jds(spark, sf_dir).withColumn("created_at", F.col("created_at").cast(T.TimestampType()))
    matching.prepare_profiles(v.skilled_profiles(spark, sf_dir), "tier", "api_key_encrypted").write.parquet(stored)
    day = F.dayofmonth("created_at")
    # The rows are made once; the folder of a run is moved to where the stream reads.
    runs, staged = (day <= 8, (day > 8) & (day <= 20), day > 20), work_dir(spark, "staged")
    of_run = F.coalesce(*(F.when(part, n) for n, part in enumerate(runs)))
    rows.withColumn("run", of_run).where("run IS NOT NULL").write.partitionBy("run").parquet(staged)
    for n in range(len(runs)):
        if streams.exists(spark, f"{staged}/run={n}"):
            streams.move_in(spark, f"{staged}/run={n}", f"{arriving}/run-{n}")
        else:
            spark.createDataFrame([], rows.schema).write.parquet(f"{arriving}/run-{n}")
        stream = streams.read_stream(spark, rows.schema, f"{arriving}/*")
        streams.stream_admitted(stream, spark.read.parquet(stored), v.KNOWN_LOCATIONS, out, state).awaitTermination()
    return spark.read.parquet(out).select("id", "ats_score", "role_level_score", "composite_score", "verdict")


@query
def k3_stream_daily_usage(spark, sf_dir):
    arriving, out, state = (work_dir(spark, n) for n in ("usage", "used", "state"))
    rows = v.usage_items(spark, sf_dir).withColumn("ts", F.col("ts").cast(T.TimestampType()))
    rows.write.parquet(arriving)
    stream = streams.read_stream(spark, rows.schema, arriving)
    streams.update_to(streams.stream_daily_usage(stream, "40 days"), out, state).awaitTermination()
    return streams.usage_of_days(spark, out).select("user_id", ts("period").alias("period"), "used")


@query
def k4_incremental_intelligence(spark, sf_dir):
    """Intelligence of closed batches out of the counts that triggers wrote."""
    arriving, out, state, final = (work_dir(spark, n) for n in ("results", "parts", "state", "final"))
    times = v.screenings(spark, sf_dir).select("seq", F.col("created_at").cast(T.TimestampType()).alias("created_at"))
    rows = covered(spark, sf_dir, times).withColumn("fake_em_detection", _detection()).withColumn("job_title", _dashed())
    # Three triggers' files arrive; rows that lie in as many parts already are not shuffled for that.
    (rows.coalesce(8) if rows.rdd.getNumPartitions() > 6 else rows.repartition(8)).write.parquet(arriving)
    stored = spark.read.parquet(arriving)
    streams.stream_parts(streams.read_stream(spark, stored.schema, arriving, max_files=3), out, state).awaitTermination()
    newest = stored.agg(F.max("created_at")).first()[0]
    done = streams.finalize_closed(spark, out, final, 1, F.lit(newest), "2 hours")
    return done.select("batch_id", "total_jds", "red_flags_count", joined("top_missing_from_profile").alias("missing"))


def _closed(spark, sf_dir) -> DataFrame:
    """Batches that are closed when the last row has come, from files in no order of time."""
    arriving, out, state = (work_dir(spark, n) for n in ("results", "closed", "state"))
    rows = v.with_error_rows(v.screenings(spark, sf_dir)).select(
        "id", "batch_id", "verdict", F.col("created_at").cast(T.TimestampType()).alias("created_at"))
    rows.repartition(6, "id").write.parquet(arriving)
    stream = streams.read_stream(spark, rows.schema, arriving, max_files=2)
    streams.stream_batch_counts(stream, out, state).awaitTermination()
    parts = materialize(spark.read.parquet(out), "parts")
    moment = parts.agg(F.max("newest_at")).first()[0]
    return streams.closed_batches(parts, F.lit(moment), "2 hours")


@query
def k4_stream_finalize(spark, sf_dir):
    return _closed(spark, sf_dir).withColumns({c: ts(c) for c in ("first_at", "closed_at")})


@query
def k4_finalized_intelligence(spark, sf_dir):
    """Intelligence of the closed batches of three rows or more."""
    closed = materialize(_closed(spark, sf_dir).select("batch_id"), "closed")
    rows = covered(spark, sf_dir).withColumn("fake_em_detection", _detection()).withColumn("job_title", _dashed())
    out = insight.batch_intelligence(rows.join(closed, "batch_id", "left_semi"))
    return out.select("batch_id", "total_jds", "red_flags_count", joined("top_missing_from_profile").alias("missing"))


# --- pluggable scorer -------------------------------------------------------------------

def length_scorer(frames):
    """A stand-in scorer: scores follow from text lengths, long resumes fail with 500."""
    for pdf in frames:
        chars, resume = pdf["jd_text"].str.len(), pdf["resume"].str.len()
        yield pdf[["id", "batch_id", "seq"]].assign(
            status=(200 + 300 * (resume > 2000)).astype("int32"),
            ats_score=(chars % 101).astype("int32"), role_level_score=(resume % 101).astype("int32"))


@query
def l1_score_with(spark, sf_dir):
    people = v.profiles(spark, sf_dir).withColumn("resume", matching.resume_for_scoring())
    rows = matching.with_profile(v.jds(spark, sf_dir), people, ["resume"])
    answers = matching.score_with(
        rows.select("id", "batch_id", "seq", "jd_text", "resume"), length_scorer,
        "id string, batch_id string, seq long, status int, ats_score int, role_level_score int")
    composite = scores.composite_score(F.col("ats_score"), F.col("role_level_score"))
    return answers.withColumn("composite_score", composite)


# --- whole flows --------------------------------------------------------------------------

@query
def p1_screen_batches(spark, sf_dir):
    out = flows.screen_batches(
        v.jds(spark, sf_dir), v.skilled_profiles(spark, sf_dir), v.KNOWN_LOCATIONS)
    return out.select("id", "ats_score", "role_level_score", "composite_score", "verdict",
                      joined("hard_reject_reasons").alias("reasons"))


def moody_scorer(frames):
    """A stand-in scorer that also answers with each kind of failure."""
    for pdf in frames:
        chars, resume = pdf["jd_text"].str.len(), pdf["resume"].str.len()
        status = (resume * 0 + 200).mask(resume > 2000, 500).mask(chars % 31 == 0, 429).mask(chars % 53 == 0, 401)
        yield pdf[["batch_id", "seq", "jd_text"]].assign(
            id="r" + pdf["seq"].astype(str), job_title="scored", company=None,
            ats_score=(chars % 101).astype("int32"), role_level_score=(resume % 101).astype("int32"),
            composite_score=50, verdict="WEAK", hard_reject_reasons=[[] for _ in range(len(pdf))],
            status=status.astype("int32"), detail_items=None, detail=None, error="failed", status_text="Error")


ANSWER = (
    "batch_id string, seq long, id string, job_title string, company string, jd_text string, ats_score int,"
    " role_level_score int, composite_score int, verdict string, hard_reject_reasons array<string>, status int,"
    " detail_items array<struct<loc array<string>, msg string>>, detail string, error string, status_text string")


@query
def p1_screen_with(spark, sf_dir):
    jds = v.jds(spark, sf_dir).withColumns({
        "batch_id": F.col("user_id"), "job_title": F.when(F.col("seq") % 2 == 0, F.col("job_title"))})
    out = flows.screen_with(jds, v.profiles(spark, sf_dir), moody_scorer, ANSWER, quota=True)
    return out.select("id", "user_id", "seq", "job_url", "job_title", "ats_score", "role_level_score", "verdict",
                      joined("hard_reject_reasons").alias("reasons"))


@query
def p1_refused_items(spark, sf_dir):
    """Some items without a batch or a text, some users without a profile."""
    n = F.col("seq")
    jds = v.jds(spark, sf_dir).withColumns({
        "batch_id": F.when(n % 19 != 0, F.col("batch_id")), "jd_text": F.when(n % 13 != 0, F.col("jd_text")).otherwise(" \n")})
    people = v.profiles(spark, sf_dir).where("tier = 'free'")
    return matching.refused_items(jds, people)


def _run(spark, sf_dir) -> flows.Screening:
    """A run over all items, some without a batch or a text, behind the counters of the profiles."""
    n = F.col("seq")
    jds = v.jds(spark, sf_dir).withColumns({
        "batch_id": F.when(n % 19 != 0, F.col("batch_id")), "jd_text": F.when(n % 13 != 0, F.col("jd_text")).otherwise(" \n")})
    people = v.skilled_profiles(spark, sf_dir)
    used = people.select(
        F.col("id").alias("user_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("period"), F.col("screens_used_this_month").alias("used"))
    return flows.run_screening(jds, people, v.KNOWN_LOCATIONS, used_before=used)


@query
def p1_run_results(spark, sf_dir):
    return _run(spark, sf_dir).results.select("id", "ats_score", "role_level_score", "composite_score", "verdict")


@query
def p1_run_refused(spark, sf_dir):
    return _run(spark, sf_dir).refused


@query
def p1_run_usage(spark, sf_dir):
    return _run(spark, sf_dir).usage.select("user_id", ts("period").alias("period"), "used")


@query
def p1_fatal_errors(spark, sf_dir):
    items = matching.classify_outcome(v.outcomes(spark, sf_dir)).withColumn("batch_id", F.col("user_id"))
    return matching.fatal_errors(items)


@query
def p1_ranked_report(spark, sf_dir):
    return flows.ranked_report(v.screenings(spark, sf_dir)).withColumn(
        "position", F.col("position").cast("long"))


@query
def p2_history_page(spark, sf_dir):
    return numbered(flows.history_page(
        v.screenings(spark, sf_dir), v.tracker(spark, sf_dir), "DECENT", "src", n=20
    ).select("user_id", "batch_id", "id", "tracked", ts("batch_at").alias("batch_at")))


@query
def p3_report_page(spark, sf_dir):
    headers, frozen, _ = _publish(spark, sf_dir)
    page = flows.report_page(headers, frozen, v.profiles(spark, sf_dir), now())
    return page.select("batch_id", "full_name", "roles", "worth_a_look", "headline")
