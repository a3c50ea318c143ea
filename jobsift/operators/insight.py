"""What a batch says about the market.

Inputs are result rows: batch_id, user_id, id, job_title, matching_skills and
missing_skills (arrays).  Each report counts (batch, skill) pairs first, so the
shuffles carry counts and not rows.  Reports are whole and ranked unless a ``k`` is given.
Several reports read their input more than once, so give them a stored table.  The functions
that end in ``_of`` start from counts, which may have been added up from parts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsift import constants as K
from jobsift.functions import scores
from jobsift.skew import hot_keys, position_in_group, salt_of, spread_join, top_k


def _skill_rows(df: DataFrame, skills: Column, keys: Sequence[str]) -> DataFrame:
    """One row per (key, JD, skill); a JD counts once for a skill."""
    return df.select(*keys, F.explode(F.array_distinct(skills)).alias("skill"))


def _no_strings() -> Column:
    return F.array().cast("array<string>")


#: Rows of a batch (or user) whose skills are still counted and ranked by one task.
WHOLE_ROWS = 50_000


def _skill_lists(df: DataFrame, key: str) -> DataFrame:
    """Per row the key, all its skills, the missing ones first, and how many are missing."""
    missing = F.coalesce("missing_skills", _no_strings())
    # The union lists the distinct missing skills first, so the position tells them apart.
    every = F.array_union(missing, F.coalesce("matching_skills", _no_strings()))
    return df.select(key, F.size(F.array_distinct(missing)).alias("_missing"), every.alias("_every"))


def _counted(lists: DataFrame, key: str) -> DataFrame:
    return (
        # The lists are computed below the explode, else every exploded row would carry them.
        lists.select(key, "_missing", F.posexplode("_every").alias("_pos", "skill"))
        .groupBy(key, "skill")
        .agg(F.count("*").alias("jds"), F.count_if(F.col("_pos") < F.col("_missing")).alias("lacking_jds"))
    )


def _by_size(
    df: DataFrame, key: str, report: Callable[[DataFrame, bool], DataFrame], kept: DataFrame | None = None, both: bool = False,
    sizes_of: DataFrame | None = None,
) -> DataFrame:
    """``report(skill counts, whole)`` of all keys, or of those in ``kept``.

    The lists of a key with fewer than ``WHOLE_ROWS`` rows are brought together as they are;
    its skills are then counted, and ranked, where they lie (``whole``), so nothing exploded is
    shuffled.  Rows of larger keys are counted before their counts meet.  With ``both`` the two
    ways stand in the plan without a look at the rows; one that has none is dropped as it runs.
    ``sizes_of`` may give the key column of the same rows from a frame that is cheaper to read.
    """
    def of(lists: DataFrame, whole: bool) -> DataFrame:
        together = lists.repartition(key) if whole else lists
        if kept is not None:
            together = together.join(kept.select(key), key, "left_semi") if whole else spread_join(
                together.withColumn("_row", F.monotonically_increasing_id()), kept.select(key), [key], "left_semi", ["_row"]).drop("_row")
        return report(_counted(together, key), whole)

    lists, hot = _skill_lists(df, key), hot_keys(df if sizes_of is None else sizes_of, [key], WHOLE_ROWS)
    if not both and hot.isEmpty():
        return of(lists, True)
    # At most (rows / WHOLE_ROWS) keys; rows without a key go with the large ones.
    marked = lists.join(F.broadcast(hot.select(key, F.lit(True).alias("_large"))), key, "left").withColumn(
        "_large", F.coalesce("_large", F.col(key).isNull()))
    small, large = (marked.where(F.col("_large") == x).drop("_large") for x in (False, True))
    return of(small, True).unionByName(of(large, False))


def skill_counts(df: DataFrame, key: str = "batch_id", sizes_of: DataFrame | None = None) -> DataFrame:
    """Per key and skill: the JDs asking for it and the JDs whose owner lacks it."""
    return _by_size(df, key, lambda counts, whole: counts, sizes_of=sizes_of)


def batch_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("batch_id").agg(F.count("*").alias("total_jds"))


def min_batch(df: DataFrame, n: int = K.MIN_BATCH_FOR_INTELLIGENCE) -> DataFrame:
    """Batches large enough for intelligence, with their size."""
    return batch_sizes(df).where(F.col("total_jds") >= n)


def _ranked(counts: DataFrame, item: str, k: int | None, whole: bool = False) -> DataFrame:
    """Counts of items per batch with their ``rank``, most JDs first: the first ``k``, or all.

    A whole list is numbered in stretches of equal counts and first letters, none in one task;
    one that a task holds already (``whole``) is numbered there.
    """
    order = [F.col("jds").desc(), F.col(item).asc()]
    if k is not None:
        return top_k(counts, ["batch_id"], order, k, spread_by=[item])
    if whole:
        # Rows without a batch have no list, as below.
        return counts.where("batch_id IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("batch_id").orderBy(*order)))
    buckets = [("_jds", F.col("jds"), False), ("_start", F.substring(item, 1, 2), True)]
    return position_in_group(counts, ["batch_id"], buckets, order, "rank").withColumn("rank", F.col("rank").cast("int"))


def _both_ranks(counts: DataFrame, k: int) -> DataFrame:
    """Skills among the first ``k`` of their batch, by demand (``rank``) or by what is missing (``_lacking_rank``).

    Both are found in one pass over the counts; what a batch's parts keep meets afterwards,
    2 * ``k`` skills of each part at most.
    """
    orders = {"rank": [F.col("jds").desc(), F.col("skill").asc()],
              # Skills that nobody lacks come behind the last.
              "_lacking_rank": [F.col("lacking_jds").desc(), F.col("skill").asc()]}
    out = counts.withColumn("_salt", salt_of(["skill"]))
    for keys in (["batch_id", "_salt"], ["batch_id"]):
        by = {name: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) for name, order in orders.items()}
        out = out.withColumns(by).withColumn("_lacking_rank", F.when(F.col("lacking_jds") > 0, F.col("_lacking_rank"))).where(
            (F.col("rank") <= k) | (F.col("_lacking_rank") <= k))
    return out.drop("_salt", "lacking_jds")


def demand_of(counts: DataFrame, sizes: DataFrame, k: int | None = K.TOP_SKILLS) -> DataFrame:
    """:func:`skill_demand` from skill counts and batch sizes."""
    best = _ranked(counts.drop("lacking_jds"), "skill", k)
    return _with_share(best, sizes)


def _with_share(best: DataFrame, sizes: DataFrame) -> DataFrame:
    tenths = F.floor((F.col("jds") * 2000 + F.col("total_jds")) / (F.col("total_jds") * 2))
    return (
        best.join(sizes.select("batch_id", "total_jds"), "batch_id")
        .withColumn("percentage", tenths / 10)
        .withColumn("trend", scores.trend(F.col("jds") * 100 / F.col("total_jds")))
    )


def skill_demand(df: DataFrame, k: int | None = K.TOP_SKILLS) -> DataFrame:
    """Per batch the ``k`` skills most JDs ask for, with share and trend.

    ``percentage`` is in tenths of a percent rounded half up, divided by ten.
    """
    return _with_share(_by_size(
        df, "batch_id", lambda counts, whole: _ranked(counts.drop("lacking_jds"), "skill", k, whole), both=True), batch_sizes(df))


def missing_of(counts: DataFrame, k: int | None = None, whole: bool = False) -> DataFrame:
    """:func:`top_missing` from skill counts."""
    return _ranked(_lacking(counts), "skill", k, whole)


def top_missing(df: DataFrame, k: int | None = None) -> DataFrame:
    """Per batch the skills that the profile lacks, ranked by how many JDs ask for them: all, or the first ``k``."""
    return _by_size(df, "batch_id", lambda counts, whole: missing_of(counts, k, whole))


def _lacking(counts: DataFrame) -> DataFrame:
    return counts.where("lacking_jds > 0").drop("jds").withColumnRenamed("lacking_jds", "jds")


def batch_matching_skills(df: DataFrame) -> DataFrame:
    """Distinct (batch, skill) pairs of matching skills, as rows since a batch has no size limit."""
    return _skill_rows(df, F.col("matching_skills"), ["batch_id"]).distinct()


def flag_in_profile(skills: DataFrame, matching: DataFrame) -> DataFrame:
    """Add ``in_profile`` to (batch_id, skill) rows; case is ignored."""
    owned = matching.select(
        "batch_id", F.lower("skill").alias("_low")).distinct().withColumn("_has", F.lit(True))
    return (
        skills.withColumn("_low", F.lower("skill"))
        .join(owned, ["batch_id", "_low"], "left")
        .withColumn("in_profile", F.col("_has").isNotNull()).drop("_low", "_has")
    )


def title_pattern(title: Column) -> Column:
    """Lower-cased title up to the first spaced dash."""
    return F.trim(F.regexp_replace(F.lower(title), r"(?s)\s+[-–—]\s.*", ""))


def title_counts(df: DataFrame) -> DataFrame:
    """Per batch and title pattern the JDs that have it."""
    return (
        df.select("batch_id", title_pattern(F.col("job_title")).alias("pattern"))
        .where("pattern <> ''").groupBy("batch_id", "pattern").agg(F.count("*").alias("jds")))


def titles_of(counts: DataFrame, k: int | None = None) -> DataFrame:
    """:func:`title_patterns` from title counts."""
    return _ranked(counts, "pattern", k)


def title_patterns(df: DataFrame, k: int | None = None) -> DataFrame:
    """Per batch the title patterns, ranked by how common they are: all, or the first ``k``."""
    return titles_of(title_counts(df), k)


def red_flag_count(df: DataFrame) -> DataFrame:
    """Per batch the rows whose manager title looks inflated (struct fake_em_detection)."""
    return df.groupBy("batch_id").agg(
        F.count_if(scores.inflated_manager(F.col("fake_em_detection"))).alias("red_flags_count"))


def blocking_skills(df: DataFrame, k: int = 2) -> DataFrame:
    """Per user: the ``k`` skills missing most often, and the share of JDs missing any of them."""
    lacking = _lacking(skill_counts(df, "user_id"))
    worst = (
        top_k(lacking, ["user_id"], [F.col("jds").desc(), F.col("skill").asc()], k, spread_by=["skill"])
        # At most k items per user.
        .groupBy("user_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "skill"))),
                         lambda x: x["skill"]).alias("blockers"))
    )
    marked = spread_join(
        df.select("user_id", "id", "missing_skills"), worst, ["user_id"], "inner", spread_by=["id"])
    blocked = F.coalesce(F.arrays_overlap("missing_skills", "blockers"), F.lit(False))
    return marked.groupBy("user_id").agg(
        F.any_value("blockers").alias("blockers"),
        F.count_if(blocked).alias("blocked_jds"), F.count("*").alias("jds"),
    ).withColumn("blocked_percent", F.floor(
        (F.col("blocked_jds") * 200 + F.col("jds")) / (F.col("jds") * 2)).cast("int"))


def explode_requirements(df: DataFrame) -> DataFrame:
    """One row per requirement of each result, in order, with its mark (struct column ``analysis``)."""
    return df.select("id", F.posexplode("analysis.requirements_met").alias("seq", "item")).select(
        "id", "seq", "item.*").withColumn("mark", scores.requirement_mark(F.col("status")))


def intelligence_of(
    heads: DataFrame, skills: DataFrame, titles: DataFrame,
    n: int = K.MIN_BATCH_FOR_INTELLIGENCE, k: int = K.TOP_SKILLS, top_titles: int = 5,
) -> DataFrame:
    """:func:`batch_intelligence` from counts: ``heads(batch_id, total_jds, red_flags_count)``,
    skill counts and title counts."""
    def listed(rank: str, item: Column) -> Column:
        # Lists of k items.
        found = F.array_sort(F.collect_list(F.when(F.col(rank) <= k, F.struct(F.col(rank).alias("rank"), item.alias("item")))))
        return F.transform(found, lambda x: x["item"])

    heads = heads.where(F.col("total_jds") >= n)
    ranked = _with_share(_both_ranks(skills, k), heads)
    demand = F.struct("skill", F.col("jds").alias("count"), "percentage", "trend")
    lists = ranked.groupBy("batch_id").agg(
        listed("rank", demand).alias("top_required_skills"), listed("_lacking_rank", F.col("skill")).alias("top_missing_from_profile"))
    patterns = titles_of(titles, top_titles).groupBy("batch_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "pattern"))), lambda x: x["pattern"]).alias("title_patterns"))
    return (
        heads.join(lists, "batch_id", "left").join(patterns, "batch_id", "left")
        .withColumns({
            "top_missing_from_profile": F.coalesce("top_missing_from_profile", _no_strings()),
            "title_patterns": F.coalesce("title_patterns", _no_strings()),
        })
    )


def batch_heads(df: DataFrame) -> DataFrame:
    """Per batch its rows and how many of them have an inflated manager title."""
    return df.groupBy("batch_id").agg(
        F.count("*").alias("total_jds"),
        F.count_if(scores.inflated_manager(F.col("fake_em_detection"))).alias("red_flags_count"))


def batch_intelligence(
    df: DataFrame, n: int = K.MIN_BATCH_FOR_INTELLIGENCE, k: int = K.TOP_SKILLS, titles: int = 5
) -> DataFrame:
    """One row per batch of ``n`` rows or more, joining the reports above.

    Every list in this nested view is a top-k, so no row grows with the batch;
    :func:`intelligence_lists` gives the whole lists as rows.  Rows of smaller batches go
    before anything is exploded.
    """
    heads = batch_heads(df).where(F.col("total_jds") >= n)
    skills = _by_size(df, "batch_id", lambda counts, whole: counts, heads)
    return intelligence_of(heads, skills, title_counts(df), n, k, titles)


def intelligence_lists(df: DataFrame, n: int = K.MIN_BATCH_FOR_INTELLIGENCE) -> DataFrame:
    """``(batch_id, list, rank, item, jds)``: the whole lists of a batch, none cut.

    Lists: ``required``, ``missing`` and ``titles``, for batches of ``n`` rows or more.
    """
    heads = batch_heads(df).where(F.col("total_jds") >= n)

    def skills(counts: DataFrame, whole: bool) -> DataFrame:
        order = {"required": F.col("jds"), "missing": F.col("lacking_jds")}
        if whole:
            # Both lists of a batch are numbered by the task that counted it.
            ranks = F.array(*[F.struct(F.lit(name).alias("list"), F.row_number().over(Window.partitionBy("batch_id").orderBy(
                n_jds.desc(), F.col("skill").asc())).alias("rank"), F.col("skill").alias("item"), n_jds.alias("jds")) for name, n_jds in order.items()])
            return counts.select("batch_id", ranks.alias("_both")).select("batch_id", F.inline("_both")).where("jds > 0")
        return shown("required", _ranked(counts.drop("lacking_jds"), "skill", None), "skill").union(shown("missing", missing_of(counts), "skill"))

    def shown(name: str, reports: DataFrame, item: str) -> DataFrame:
        return reports.select("batch_id", F.lit(name).alias("list"), "rank", F.col(item).alias("item"), "jds")

    titles = titles_of(title_counts(df).join(heads.select("batch_id"), "batch_id", "left_semi"))
    return _by_size(df, "batch_id", skills, heads).union(shown("titles", titles, "pattern"))
