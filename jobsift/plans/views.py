"""The test tables seen as screening data.

Each view derives rows from whole tables; no view filters by id, samples or cuts
text.  ``plans/oracle.py`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.functions.scores import composite_score, verdict

LEVEL_WORDS = ["Junior", "Mid", "Senior", "Lead", "Staff", "Principal", "Manager",
               "Director", "VP", "Engineer", "Consultant"]
CITIES = ["India", "USA", "Remote", "Germany", "nowhere", "France"]
KNOWN_LOCATIONS = ["India", "USA", "Remote", "Germany", "France"]
STACKS = ["Java", "C#", ".NET", "PHP", "Spark SQL", "Kotlin", "Node.js", "C++", "COBOL"]
ROLE_TYPES = ["permanent", "contract", "internship", "part-time", "full time"]
FIRMS = ["staffing", "outsourcing", "consulting", "product"]
DEALBREAKERS = ["C#", ".NET", "PHP", "Spark SQL", "COBOL", "C++", "Perl", "Delphi"]
ALLOWED = ["India", "Remote", "USA", "Germany"]
ROLES_OUT = ["internship", "contract", "part-time"]
LIKED = ["Java", "Kotlin", "Spark SQL", "Python", "Node.js"]
INDUSTRIES = ["fintech", "SaaS", "healthtech", "e-commerce"]
STATUSES = ["Applied", "Interviewing", "Offer", "Rejected", "Withdrawn"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.lit(words), (index % len(words) + 1).cast("int"))


def some(words: list[str], start: Column, length: Column) -> Column:
    return F.slice(F.lit(words), start.cast("int"), length.cast("int"))


def screenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result row per document, owned by the user of the event with the same id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "user_id", "ts")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = docs.join(events, "doc_id").join(pages, "doc_id", "left").join(labels, "doc_id", "left")
    n = F.col("doc_id")
    rejected = (F.coalesce("toxic", F.lit(0)) == 1) | (n % 7 == 0)
    ats = ((n * 37 + 13) % 101).cast("int")
    role = ((n * 53 + 29) % 101).cast("int")
    score = F.when(rejected, 0)
    reasons = F.when(rejected, F.when(n % 2 == 0, F.array(F.concat(F.lit("rule "), (n % 5).cast("string"))))
                     .otherwise(F.array(F.lit("rule a"), F.lit("rule b")))
                     ).otherwise(F.array().cast("array<string>"))
    advice = pick(["APPLY IF ", "APPLY ", "SKIP ", "apply\n", "Maybe "], n)
    return rows.select(
        n.cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("batch_id"),
        n.alias("seq"), F.col("url").alias("job_url"),
        F.concat(pick(LEVEL_WORDS, n), F.lit(" "), "source").alias("job_title"),
        F.when(n % 17 != 0, F.col("source")).alias("company"),
        F.col("text").alias("jd_text"),
        score.otherwise(ats).alias("ats_score"), score.otherwise(role).alias("role_level_score"),
        score.otherwise(composite_score(ats, role)).alias("composite_score"),
        verdict(composite_score(ats, role), rejected).alias("verdict"),
        reasons.alias("hard_reject_reasons"),
        F.when(n % 3 == 0, F.col("text")).alias("headline"),
        F.when(n % 4 != 0, F.concat(advice, F.col("text"))).alias("recommendation"),
        F.col("ts").alias("created_at"),
    )


def with_error_rows(results: DataFrame) -> DataFrame:
    """Some rows turned into failed items: no id, reject, zero scores."""
    failed = F.col("seq") % 23 == 0
    return results.withColumns({
        "id": F.when(failed, "").otherwise(F.col("id")),
        "verdict": F.when(failed, "REJECT").otherwise(F.col("verdict")),
        **{c: F.when(failed, 0).otherwise(F.col(c))
           for c in ("ats_score", "role_level_score", "composite_score")},
    })


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer responses for every screening, with failures of each kind."""
    n = F.col("seq")
    status = F.when(n % 211 == 0, 401).when(n % 97 == 0, 429).when(n % 23 == 0, 500).otherwise(200)
    item = F.struct(F.array(F.lit("body"), "job_title").alias("loc"), F.lit("is wrong").alias("msg"))
    return screenings(spark, sf_dir).withColumn("status", status).withColumns({
        "detail_items": F.when(n % 2 == 0, F.array(item, item)),
        "detail": F.when(n % 3 == 0, F.concat(F.lit("detail "), "company")),
        "error": F.when(n % 5 == 0, F.col("job_title")),
        "status_text": F.lit("Server Error"),
    })


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per user seen in the events."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), "text")
    u = F.col("user_id")
    filters = F.struct(
        some(DEALBREAKERS, u % 3 + 1, u % 6).alias("tech_stack_dealbreakers"),
        F.when(u % 11 == 10, "").otherwise(pick(LEVEL_WORDS, u)).alias("title_floor"),
        some(ALLOWED, u % 4 + 1, u % 3).alias("geography_allowed"),
        some(FIRMS[:3], F.lit(1), u % 4).alias("company_type_excluded"),
        some(ROLES_OUT, u % 2 + 1, u % 3).alias("role_type_excluded"),
    )
    prefs = F.struct(
        some(LIKED, u % 3 + 1, u % 5).alias("preferred_tech_stack"),
        some(INDUSTRIES, F.lit(1), u % 4).alias("target_industries"),
        F.when(u % 5 != 0, u % 5 * 10).cast("int").alias("min_company_size"),
        F.when(u % 4 != 0, F.lit(1000)).alias("max_company_size"),
        (u % 2 == 0).alias("onboarding_completed"),
    )
    start = F.lit("2023-12-01 00:00:00").cast("timestamp_ntz")
    return users.join(people, "user_id").join(docs, "user_id", "left").select(
        u.cast("string").alias("id"),
        F.concat(F.lit("u"), u.cast("string"), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("full_name"),
        F.when(u % 3 == 1, F.col("text")).when(u % 3 == 2, F.lit(" \n\t ")).alias("resume_text"),
        F.when(u % 4 == 1, "").when(u % 4 > 1, F.concat(F.lit("k"), u.cast("string"))).alias("api_key_encrypted"),
        F.when(u % 2 == 0, "openai").otherwise("anthropic").alias("api_provider"),
        filters.alias("hard_reject_filters"), prefs.alias("preferences"),
        F.when(F.col("c_mktsegment") == "BUILDING", "paid").otherwise("free").alias("tier"),
        (u % 7).cast("int").alias("screens_used_this_month"),
        start.alias("created_at"), start.alias("updated_at"),
        F.when(u % 2 == 0, F.concat(F.lit("o"), u.cast("string"))).alias("pending_order_id"),
    )


def words_of(text: Column) -> Column:
    """Distinct lower-case ASCII words of two letters or more, over the whole text."""
    # Repeats go first, so each word is tested once.
    return F.filter(F.array_distinct(F.split(F.lower(text), "[^a-z]+")), lambda w: F.length(w) >= 2)


def jds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job texts with place, stack, type and firm lines added, and their required skills."""
    n = F.col("seq")
    extra = F.concat(
        F.lit("\nLocation: "), pick(CITIES, n), F.lit(". Stack: "), pick(STACKS, n), F.lit(", "),
        pick(STACKS, F.floor(n / 9)), F.lit(". Type: "), pick(ROLE_TYPES, F.floor(n / 5)),
        F.lit(". Firm: "), pick(FIRMS, F.floor(n / 11)))
    return screenings(spark, sf_dir).select(
        "id", "user_id", "batch_id", "seq", "job_url", "job_title", "company",
        F.concat("jd_text", extra).alias("jd_text"),
        words_of(F.col("jd_text")).alias("required_skills"), "created_at")


def skilled_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with the words of the user's own document as skills."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("_text"))
    return profiles(spark, sf_dir).join(docs, "id", "left").withColumn(
        "profile_skills", words_of(F.col("_text"))).drop("_text")


def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tracked job per click; every tenth has no linked result."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").where("event_type = 'click'").select(
        F.concat(F.lit("t"), n.cast("string")).alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(n % 10 != 0, n.cast("string")).alias("screening_result_id"),
        F.concat(pick(LEVEL_WORDS, n), F.lit(" role")).alias("job_title"),
        F.concat(F.lit("firm"), (n % 20).cast("string")).alias("company"),
        F.lit(None).cast("string").alias("job_url"),
        pick(STATUSES, n).alias("status"),
        F.when(n % 4 == 0, F.col("props")).alias("notes"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(hours=(n % 48).cast("int"))).alias("updated_at"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment webhook bodies: purchases are captured, errors are cancellations."""
    n = F.col("event_id")
    email = F.when(n % 13 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")))
    notes = F.when(email.isNull(), F.lit("{}")).otherwise(
        F.concat(F.lit('{"user_email":"'), email, F.lit('"}')))
    kind = F.when(F.col("event_type") == "purchase", "payment").when(
        F.col("event_type") == "error", "subscription").otherwise("other")
    name = F.when(kind == "payment", "payment.captured").when(
        kind == "subscription", "subscription.cancelled").otherwise("order.paid")
    body = F.concat(
        F.lit('{"event":"'), name, F.lit('","payload":{"'), kind, F.lit('":{"entity":{"notes":'),
        notes, F.lit("}}}}"))
    return table(spark, sf_dir, "events").select("event_id", "ts", body.alias("body"))


def usage_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one screening attempt; errors are failures."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("item_id"), F.col("user_id").cast("string").alias("user_id"), "ts",
        (F.col("event_type") != "error").alias("success"))
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "paid").otherwise("free").alias("tier"))
    return events.join(people, "user_id")


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose root links point below /jobs/, with posting ids on links and items."""
    pid = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 3 == 0, F.concat(
            F.regexp_replace("url", "[?#].*$", ""), F.lit("?currentJobId=4"), pid)
        ).otherwise(F.col("url")).alias("url"),
        F.replace(F.replace(F.replace(
            F.col("html"),
            F.lit('href="/'), F.concat(F.lit('href="/jobs/'), F.lit("1"), pid, F.lit("-"))),
            F.lit("<li>"), F.concat(F.lit('<li data-job-id="20000'), pid, F.lit('">'))),
            F.lit("<p>"), F.concat(
                F.lit('<p class="x" data-entity-urn="urn:li:jobPosting:3'), pid,
                F.lit('"><a href="/jobs/view/5'), pid, F.lit('?currentJobId=6&amp;x=1">l</a>'))
        ).alias("html"),
    )


def url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted lists: each page's URL with its neighbours, blanks and noise, one list per page."""
    pid = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("batch_id"),
        F.concat(
            F.lit("  "), "url", F.lit("\n\n \t\nnot a link\n"),
            F.regexp_replace("url", "^https?://", ""), F.lit(" \r\nwww.linkedin.com/jobs\n"),
            F.lit("https://www.linkedin.com/jobs/collections/recommended/?currentJobId="), pid,
            F.lit("&origin=x\nhttps://in.linkedin.com/jobs?x=1\n　"), "url", F.lit("\n"),
        ).alias("pasted"))


def tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one comma list."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_replace("text", r"[.\n]", ",").alias("list"))


def noisy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, some emptied and some with control characters between their letters."""
    n = F.col("doc_id")
    noisy = F.regexp_replace("text", "e", "\u0001\u0002e")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(n % 50 == 1, F.lit("  \n")).when(n % 50 == 2, noisy)
        .when(n % 50 == 3, F.repeat("text", 30)).otherwise(F.col("text")).alias("text"))


def tracked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to track: signups, twice for some, on their own result or on none."""
    n = F.col("event_id")
    events = table(spark, sf_dir, "events").where("event_type in ('click', 'signup')")
    return events.withColumn("again", F.explode(F.when(n % 3 == 0, F.lit([0, 1])).otherwise(F.lit([0])))).select(
        (n * 2 + F.col("again")).alias("request_id"), F.col("user_id").cast("string").alias("user_id"),
        F.when(n % 6 != 0, n.cast("string")).when(n % 12 == 0, F.lit("")).alias("screening_result_id"),
        F.concat(F.lit("job "), n.cast("string")).alias("job_title"),
        F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("job_url"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report requests: one per batch, and every fifth also under a foreign user."""
    own = screenings(spark, sf_dir).groupBy("user_id", "batch_id").agg(
        F.count("*").alias("n"), F.max("created_at").alias("last_at"), F.min("seq").alias("first_seq"))
    return own.withColumn("foreign", F.explode(
        F.when(F.col("first_seq") % 5 == 0, F.lit([False, True])).otherwise(F.lit([False])))).select(
        F.concat_ws("/", "batch_id", F.when(F.col("foreign"), "x").otherwise("o")).alias("request_id"),
        F.when(F.col("foreign"), F.lit("-1")).otherwise(F.col("user_id")).alias("user_id"),
        "batch_id", "last_at")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of published batches; the expiry follows the batch's last row."""
    rolled = screenings(spark, sf_dir).groupBy("user_id", "batch_id").agg(
        F.max("created_at").alias("last_at"))
    return rolled.select(
        F.col("batch_id").alias("id"), "user_id", "batch_id",
        F.substring(F.md5("batch_id"), 1, 16).alias("slug"),
        (F.col("last_at") + F.make_dt_interval(days=F.lit(30))).alias("expires_at"),
        F.col("last_at").alias("created_at"))


def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment confirmations from purchases; some name another user's order."""
    n = F.col("event_id")
    owner = F.col("user_id") + F.when(n % 5 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        n.alias("payment_id"), F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("o"), owner.cast("string")).alias("order_id"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile patches from signups; which fields are present varies, null included."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select(
        n.alias("patch_id"), F.col("user_id").cast("string").alias("user_id"), "ts",
        F.when(n % 4 != 0, F.concat(F.lit("name "), n.cast("string"))).alias("full_name"),
        (n % 2 == 0).alias("has_full_name"),
        F.when(n % 9 != 0, F.col("props")).alias("resume_text"), (n % 3 == 0).alias("has_resume_text"),
        F.when(n % 2 == 0, "openai").otherwise("anthropic").alias("api_provider"),
        (n % 5 == 0).alias("has_api_provider"),
        F.when(n % 7 == 0, F.concat(F.lit("k"), n.cast("string"))).when(n % 7 == 1, "").alias("api_key_encrypted"))


def tracker_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates per click: some by another user, some with a wrong status."""
    n = F.col("event_id")
    both = table(spark, sf_dir, "events").where("event_type = 'click'").withColumn("k", F.explode(F.lit([0, 1])))
    k = F.col("k")
    return both.select(
        (n * 2 + k).alias("update_id"), F.concat(F.lit("t"), n.cast("string")).alias("id"),
        (F.col("user_id") + F.when(n % 9 == 0, 1).otherwise(0)).cast("string").alias("user_id"),
        F.when((n + k) % 8 == 0, "Hired").when((n + k) % 3 != 0, pick(STATUSES, n + k + 1)).alias("status"),
        F.when(n % 5 != 0, F.concat(F.lit("note "), k.cast("string"))).alias("notes"),
        ((n + k) % 4 == 0).alias("has_notes"),
        (F.col("ts") + F.make_dt_interval(days=k + 3)).alias("ts"))


def principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of the paid segment."""
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").cast("string").alias("user_id"))


def skill_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance per skill: the number of letters of each word seen in the documents."""
    # The outer form: for the plain one Spark splits the texts once more, in a filter before it.
    words = F.explode_outer(F.split(F.lower("text"), "[^a-z]+")).alias("skill")
    return table(spark, sf_dir, "documents").select(words).where(
        F.length("skill") > 4).distinct().withColumn("weight", F.length("skill"))
