"""Matching job descriptions against their owner's profile.

A JD frame has: id, user_id, batch_id, seq, job_title, company, jd_text and,
for skill coverage, required_skills (array).  A profile frame has: id,
resume_text, hard_reject_filters and preferences (structs), profile_skills (array).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsift import constants as K
from jobsift.functions import scores
from jobsift.functions.profiles import effective_resume
from jobsift.functions.text import js_trim, non_empty, normalize_terms
from jobsift.skew import spread_join

EMPTY_STRINGS = "array<string>"


def _no_strings() -> Column:
    return F.array().cast(EMPTY_STRINGS)


def with_profile(
    jds: DataFrame, profiles: DataFrame, columns: Sequence[str], hot: DataFrame | None = None
) -> DataFrame:
    """JDs with ``columns`` of their owner's profile; JDs without a profile drop out.

    One user may own a large share of the JDs, hence the spread join.
    """
    owners = profiles.select(F.col("id").alias("user_id"), *columns)
    return spread_join(jds, owners, ["user_id"], "inner", spread_by=["id"], hot=hot)


def with_key(profiles: DataFrame) -> DataFrame:
    """Profiles that can screen: those with a stored key."""
    return profiles.where(non_empty(F.col("api_key_encrypted")).isNotNull())


def refused_items(jds: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(id, user_id, batch_id, reason)`` of the items that cannot be screened at all.

    The first reason counts: no batch, no profile, no key, no text.
    """
    owners = profiles.select(
        F.col("id").alias("user_id"), non_empty(F.col("api_key_encrypted")).isNotNull().alias("_key"))
    asked = jds.select("id", "user_id", "batch_id", F.coalesce(js_trim(F.col("jd_text")) == "", F.lit(True)).alias("_blank"))
    known = spread_join(asked, owners, ["user_id"], "left", spread_by=["id"])
    reason = (
        F.when(non_empty(F.col("batch_id")).isNull(), "no batch").when(F.col("_key").isNull(), "no profile")
        .when(~F.col("_key"), "no key").when(F.col("_blank"), "no text"))
    return known.select("id", "user_id", "batch_id", reason.alias("reason")).where("reason IS NOT NULL")


def without_profile(jds: DataFrame, profiles: DataFrame) -> DataFrame:
    """JDs that are refused because their owner has no profile."""
    owners = profiles.select(F.col("id").alias("user_id"))
    return spread_join(jds, owners, ["user_id"], "left_anti", spread_by=["id"])


def resume_for_scoring() -> Column:
    return effective_resume(F.col("resume_text"), F.col("preferences"), F.col("hard_reject_filters"))


# --- what a profile contributes --------------------------------------------------

def rule_set(filters: Column) -> Column:
    """The reject rules with their terms normalised, so each JD only looks them up."""
    def terms(items: Column, label: str) -> Column:
        named = F.transform(F.coalesce(items, _no_strings()), lambda x: F.struct(
            F.concat(F.lit(label), x).alias("reason"), normalize_terms(x).alias("term")))
        return F.filter(named, lambda r: F.length(r["term"]) > 1)

    floor = filters["title_floor"]
    return F.struct(
        terms(filters["tech_stack_dealbreakers"], "Tech dealbreaker: ").alias("tech"),
        floor.alias("floor"), scores.seniority_rank(floor).alias("floor_rank"),
        terms(filters["geography_allowed"], "").alias("places"),
        terms(filters["company_type_excluded"], "Excluded company type: ").alias("company"),
        terms(filters["role_type_excluded"], "Excluded role type: ").alias("role"),
    )


def prepare_profiles(profiles: DataFrame, *columns: str) -> DataFrame:
    """(id, rules, profile_skills, columns): everything per profile, done once per profile."""
    skills = F.col("profile_skills") if "profile_skills" in profiles.columns else _no_strings()
    return profiles.select(
        "id", *columns, rule_set(F.col("hard_reject_filters")).alias("rules"),
        F.array_distinct(F.transform(F.array_compact(F.coalesce(skills, _no_strings())), lambda s: F.lower(s)))
        .alias("profile_skills"),
    )


# --- hard rejects -----------------------------------------------------------

def _with_terms(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "_terms": normalize_terms(F.concat_ws("\n", "job_title", "company", "jd_text")),
        "_title_rank": scores.seniority_rank(F.col("job_title")),
    })


def _reject_reasons(known_locations: Sequence[str]) -> Column:
    """Ordered reasons a JD breaks its owner's rules (needs the columns of ``_with_terms``).

    Rules are tested against the normalised text inside the row: a profile has
    a handful of rules, so nothing is exploded or shuffled per term.
    """
    rules, text = F.col("rules"), F.col("_terms")

    def hits(items: Column) -> Column:
        return F.transform(F.filter(items, lambda r: text.contains(r["term"])), lambda r: r["reason"])

    below = F.array_compact(F.array(F.when(
        F.col("_title_rank") < rules["floor_rank"], F.concat(F.lit("Below title floor: "), rules["floor"]))))
    named = F.array_compact(F.array(*[
        F.when(text.contains(normalize_terms(F.lit(x))), F.lit(x)) for x in known_locations]))
    allowed = F.exists(rules["places"], lambda r: text.contains(r["term"]))
    outside = F.array_compact(F.array(F.when(
        (F.size(rules["places"]) > 0) & (F.size(named) > 0) & ~allowed,
        F.concat(F.lit("Outside allowed locations: "), F.array_join(named, ", ")))))
    return F.concat(
        hits(rules["tech"]), below, outside, hits(rules["company"]), hits(rules["role"]))


def apply_hard_rejects(
    jds: DataFrame, profiles: DataFrame, known_locations: Sequence[str]
) -> DataFrame:
    """Add ``hard_reject_reasons`` and ``rejected`` to every JD that has a profile."""
    joined = with_profile(jds, prepare_profiles(profiles), ["rules"])
    return (
        _with_terms(joined)
        .withColumn("hard_reject_reasons", _reject_reasons(known_locations))
        .withColumn("rejected", F.size("hard_reject_reasons") > 0)
        .drop("_terms", "_title_rank", "rules")
    )


def survivors(judged: DataFrame) -> DataFrame:
    return judged.where(~F.col("rejected"))


# --- skill coverage and role level ------------------------------------------

def _share(part: Column, whole: Column) -> Column:
    """Percentage rounded half up; a JD without requirements scores 0."""
    return F.when(whole > 0, F.floor((part * 200 + whole) / (whole * 2))).otherwise(0).cast("int")


def with_skill_lists(df: DataFrame) -> DataFrame:
    """Replace ``profile_skills`` (lower-case) by matching_skills and missing_skills.

    The distinct required skills are split by whether the profile has them; case is
    ignored, the job's first spelling is kept, and nulls in either list are left out.
    """
    mine = F.array_compact(F.coalesce("profile_skills", _no_strings()))
    wanted, plain, both = F.col("_wanted"), F.col("_plain"), F.col("_split")
    # Lists without capitals and twins: set operations hash them once and keep their order.
    # Else all words are sorted once by their lower-case form, the profile's before the job's,
    # and each is compared with the one before it: the cost of a text of n words is that of
    # sorting them, whatever capitals it has.
    word = "struct<low:string,pos:int,word:string>"
    asked = F.transform(wanted, lambda s, i: F.struct(F.lower(s).alias("low"), i.alias("pos"), s.alias("word")).cast(word))
    owned = F.transform(mine, lambda s: F.struct(s.alias("low"), F.lit(-1).alias("pos"), F.lit(None).alias("word")).cast(word))
    sorted_words = F.when(~plain, F.sort_array(F.concat(asked, owned)))

    def first(now: Column, before: Column) -> Column:
        new = (now["pos"] >= 0) & (before.isNull() | (before["low"] != now["low"]) | (before["pos"] < 0))
        hit = F.coalesce(before["low"] == now["low"], F.lit(False))
        return F.when(new, F.struct(now["pos"].alias("pos"), now["word"].alias("word"), hit.alias("hit")))

    shifted = F.concat(F.array(F.lit(None).cast(word)), F.slice("_sorted", 1, F.greatest(F.size("_sorted") - 1, F.lit(0))))
    split = F.sort_array(F.array_compact(F.zip_with("_sorted", shifted, first)))

    def words(hit: bool) -> Column:
        return F.transform(F.filter(both, lambda x: x["hit"] == hit), lambda x: x["word"])

    return (
        df.withColumn("_wanted", F.array_compact(F.coalesce("required_skills", _no_strings())))
        .withColumn("_plain", F.array_distinct(F.transform("_wanted", lambda s: F.lower(s))) == wanted)
        .withColumn("_sorted", sorted_words)
        .withColumn("_split", split)
        .withColumns({
            "matching_skills": F.when(plain, F.array_intersect(wanted, mine)).otherwise(words(True)),
            "missing_skills": F.when(plain, F.array_except(wanted, mine)).otherwise(words(False)),
        }).drop("_wanted", "_plain", "_sorted", "_split", "profile_skills"))


def ats_coverage(
    jds: DataFrame, profiles: DataFrame, weights: DataFrame | None = None, hot: DataFrame | None = None
) -> DataFrame:
    """Add matching_skills, missing_skills and ats_score (weighted share, 0 to 100).

    ``weights`` (skill, weight) gives an integer importance per skill; a skill
    without one counts 1.  ``hot`` may give the hot users (see :func:`spread_join`).
    """
    split = with_skill_lists(with_profile(jds, prepare_profiles(profiles), ["profile_skills"], hot=hot))
    matched, missing = F.size("matching_skills"), F.size("missing_skills")
    if weights is None:
        return split.withColumn("ats_score", _share(matched, matched + missing))
    # Computed below the explode, else every exploded row would carry the lists.  The outer form:
    # for the plain one Spark tests the lists in a filter first and makes them once more for that.
    # A JD without skills gives a row without a skill, which weighs nothing.
    listed = split.select(
        "id", matched.alias("_matched"), F.concat("matching_skills", "missing_skills").alias("_all"))
    items = listed.select(
        "id", "_matched", F.posexplode_outer("_all").alias("_pos", "skill")
    ).select("id", F.lower("skill").alias("skill"), (F.col("_pos") < F.col("_matched")).alias("hit"))
    importance = weights.groupBy(F.lower("skill").alias("skill")).agg(
        F.max(F.col("weight").cast("long")).alias("weight"))
    # A JD has a skill once, so the commonest has as many rows as there are JDs; they pass by a
    # table of its one weight unsorted, and adaptive execution divides a partition that is too large.
    weighed = items.join(importance.hint("shuffle_hash"), "skill", "left").withColumn(
        "weight", F.when(F.col("skill").isNotNull(), F.coalesce("weight", F.lit(1))))
    sums = weighed.groupBy("id").agg(
        F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0)).alias("_part"), F.sum("weight").alias("_whole"))
    return (
        split.join(sums, "id", "left")
        .withColumn("ats_score", F.coalesce(_share(F.col("_part"), F.col("_whole")), F.lit(0)))
        .drop("_part", "_whole")
    )


def role_level_score(jds: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``role_level_score``: ladder distance between the title and the profile's level."""
    joined = with_profile(jds, prepare_profiles(profiles), ["rules"])
    return joined.withColumn("role_level_score", scores.role_level_score(
        scores.seniority_rank(F.col("job_title")), F.col("rules")["floor_rank"])).drop("rules")


def score_joined(df: DataFrame, known_locations: Sequence[str]) -> DataFrame:
    """The whole native scorer on JDs joined with ``rules`` and ``profile_skills``."""
    judged = with_skill_lists(_with_terms(df).withColumn(
        "hard_reject_reasons", _reject_reasons(known_locations)).drop("_terms"))
    rejected = F.size("hard_reject_reasons") > 0
    listed = judged.withColumns({
        name: F.when(rejected, _no_strings()).otherwise(F.col(name))
        for name in ("matching_skills", "missing_skills")})
    matched, missing = F.size("matching_skills"), F.size("missing_skills")
    scored = listed.withColumns({
        "ats_score": F.when(rejected, 0).otherwise(_share(matched, matched + missing)),
        "role_level_score": F.when(rejected, 0).otherwise(
            scores.role_level_score(F.col("_title_rank"), F.col("rules")["floor_rank"])),
    }).withColumn("composite_score", F.when(rejected, 0).otherwise(
        scores.composite_score(F.col("ats_score"), F.col("role_level_score"))))
    return scored.withColumn("verdict", scores.verdict(F.col("composite_score"), rejected)).drop(
        "rules", "_title_rank")


def score_batch(jds: DataFrame, profiles: DataFrame, known_locations: Sequence[str]) -> DataFrame:
    """Hard rejects, skill coverage, role level, composite and verdict with one join."""
    return score_prepared(jds, prepare_profiles(profiles), known_locations)


def score_prepared(jds: DataFrame, prepared: DataFrame, known_locations: Sequence[str]) -> DataFrame:
    """:func:`score_batch` with profiles already prepared, for instance a stored table."""
    return score_joined(with_profile(jds, prepared, ["rules", "profile_skills"]), known_locations)


# --- pluggable scorer ---------------------------------------------------------

def score_with(
    df: DataFrame, fn: Callable, schema: T.StructType | str
) -> DataFrame:
    """Run a caller's scorer over the rows, batch by batch in Arrow form.

    ``fn`` takes an iterator of pandas frames and yields frames of ``schema``.
    Rows keep their partitions, so no shuffle is added.
    """
    return df.mapInPandas(fn, schema)


def classify_outcome(df: DataFrame) -> DataFrame:
    """Add ``outcome`` and ``message`` of a scorer response.

    Columns: status, detail_items array<struct<loc array<string>, msg>>, detail,
    error, status_text.  Status 401 and 429 end the batch; others fail one item.
    """
    items = F.array_join(F.transform("detail_items", lambda e: F.concat(
        F.coalesce(F.try_element_at(e["loc"], F.lit(-1)), F.lit("undefined")),
        F.lit(": "), F.coalesce(e["msg"], F.lit("undefined")))), ", ")
    failed = ~F.col("status").between(200, 299)
    return df.withColumns({
        "outcome": F.when(F.col("status") == 401, "invalid_key")
        .when(F.col("status") == 429, "rate_limit")
        .when(failed, "item_error").otherwise("ok"),
        "message": F.when(failed, F.coalesce(items, "detail", "error", "status_text")),
    })


def is_fatal() -> Column:
    return F.col("outcome").isin("invalid_key", "rate_limit")


def until_fatal(df: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Items of each batch before its first fatal outcome; the fatal item is left out.

    The first fatal position is a min per batch, so no batch is ordered in one task.
    """
    keys = list(keys)
    first = df.where(is_fatal()).groupBy(*keys).agg(F.min("seq").alias("_stop"))
    joined = spread_join(df, first, keys, "left", spread_by=["seq"])
    return joined.where(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))).drop("_stop")


def fatal_errors(df: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """One row per stopped batch: where it stopped, the kind of error and its message."""
    keys = list(keys)
    return (
        df.where(is_fatal()).groupBy(*keys)
        .agg(F.min_by(F.struct("seq", F.col("outcome").alias("type"), "message"), "seq").alias("_first"))
        .select(*keys, "_first.*"))


def assemble_results(inputs: DataFrame, scored: DataFrame, how: str = "left") -> DataFrame:
    """Result rows from the entered items and the scorer's answers.

    ``how`` is ``left`` when every item must give a row (one without an answer
    failed), ``inner`` when items without an answer were never screened.

    ``inputs``: batch_id, seq, user_id, job_url, job_title, company, jd_text.
    ``scored``: batch_id, seq, id, job_title, company, jd_text, scores, verdict,
    hard_reject_reasons, outcome, message.  Entered values win when not null.
    A failed item becomes an id-less REJECT row with the error as its reason.
    """
    names = ("job_title", "company", "jd_text")
    answers = scored.select(
        "batch_id", "seq", *[F.col(n).alias(f"_{n}") for n in names],
        "id", "ats_score", "role_level_score", "composite_score", "verdict",
        "hard_reject_reasons", "outcome", "message",
    )
    joined = inputs.join(answers, ["batch_id", "seq"], how)
    ok = F.coalesce(F.col("outcome") == "ok", F.lit(False))

    def pick(name: str, default: str | None = None) -> Column:
        found = F.coalesce(F.col(name), F.when(ok, F.col(f"_{name}")))
        return found if default is None else F.coalesce(found, F.lit(default))

    def number(name: str) -> Column:
        return F.when(ok, F.col(name)).otherwise(0).alias(name)

    return joined.select(
        F.when(ok, F.col("id")).otherwise("").alias("id"),
        "user_id", "batch_id", "seq", "job_url",
        pick("job_title").alias("job_title"), pick("company").alias("company"),
        pick("jd_text", "").alias("jd_text"),
        number("ats_score"), number("role_level_score"), number("composite_score"),
        F.when(ok, F.col("verdict")).otherwise("REJECT").alias("verdict"),
        F.when(ok, F.coalesce("hard_reject_reasons", _no_strings()))
        .otherwise(F.array(F.coalesce("message", F.lit("Screening service unreachable"))))
        .alias("hard_reject_reasons"),
    )
