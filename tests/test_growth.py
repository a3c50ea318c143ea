"""Work that must not grow faster than its input, and right results of the forms that see to it."""

import random

import pandas as pd
import pytest

from jobsift import schemas
from jobsift.operators import insight, matching, scoring
from jobsift.plans import views
from jobsift.session import recorded
from jobsift.sources import sinks


def explained(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_skill_lists_sort_words_once(spark):
    """Long lists with capitals: as word-by-word Python, and no list is searched for every word."""
    r = random.Random(3)
    words = [r.choice("aAbBcC") + r.choice("xXyY") * r.randrange(1, 4) for _ in range(60)]
    rows = [(i, [r.choice([*words, None]) for _ in range(r.randrange(60))], [w.lower() for w in r.sample(words, r.randrange(30))] + [None])
            for i in range(80)] + [(80, None, ["ax"]), (81, ["Ax", "aX"], None), (82, ["ax", "bx"], ["bx", "bx"])]
    rows.append((83, [w for k in range(20_000) for w in (f"w{k}", f"W{k}")], [f"w{k}" for k in range(0, 20_000, 2)]))
    out = matching.with_skill_lists(spark.createDataFrame(rows, "id long, required_skills array<string>, profile_skills array<string>"))
    assert "array_position" not in explained(out) and "array_contains" not in explained(out)
    got = {x["id"]: (x["matching_skills"], x["missing_skills"]) for x in out.collect()}
    for i, wanted, mine in rows:
        first = {}
        for w in wanted or []:
            if w is not None:
                first.setdefault(w.lower(), w)
        own = set(mine or [])
        assert got[i] == ([w for k, w in first.items() if k in own], [w for k, w in first.items() if k not in own]), i


def test_weighted_coverage_makes_its_lists_once(spark):
    """As plain Python, with repeated and null ids; no list is made again for a filter, no skill counted beforehand."""
    r = random.Random(7)
    words = [f"{a}{b}" for a in "aAbB" for b in ("x", "xX", "Yy", "z")]
    rows = [(None if i % 19 == 0 else str(i % 70), f"u{i % 7}", None if i % 23 == 0 else [r.choice([*words, None]) for _ in range(r.randrange(12))])
            for i in range(120)]
    own = {f"u{k}": None if k == 3 else [*r.sample(words, 6), None] for k in range(6)}
    weights = [("AX", 7), ("ax", 4), ("bxx", None), ("byy", 3), (None, 9), ("other", 5)]
    jds = spark.createDataFrame(rows, "id string, user_id string, required_skills array<string>")
    people = spark.createDataFrame(list(own.items()), "id string, profile_skills array<string>").selectExpr(
        "*", "CAST(NULL AS struct<tech_stack_dealbreakers:array<string>,title_floor:string,geography_allowed:array<string>,"
        "company_type_excluded:array<string>,role_type_excluded:array<string>>) AS hard_reject_filters")
    out = matching.ats_coverage(jds, people, spark.createDataFrame(weights, "skill string, weight int")).select("id", "ats_score")
    weigh, sums = {"ax": 7, "byy": 3}, {}
    for i, user, skills in rows:
        if user in own:
            part, whole = sums.get(i, (0, 0))
            asked, mine = {w.lower() for w in skills or [] if w}, {w.lower() for w in own[user] or [] if w}
            sums[i] = (part + sum(weigh.get(w, 1) for w in asked & mine), whole + sum(weigh.get(w, 1) for w in asked))
    sums[None] = (0, 0)
    score = {i: (200 * a + b) // (2 * b) if b else 0 for i, (a, b) in sums.items()}
    assert sorted(map(repr, out.collect())) == sorted(f"Row(id={i!r}, ats_score={score[i]})" for i, user, _ in rows if user in own)
    plan = explained(out)
    assert plan.count("array_intersect(") == plan.count("array_except(") == 1 and "explode(required_skills" not in plan, plan


def test_weights_split_the_texts_once(spark, tmp_path):
    texts = ["Gamma gamma x DELTAS, ab", None, "", "9 deltas\u00e9 omega-omegas alph"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = views.skill_weights(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [("deltas", 6), ("gamma", 5), ("omega", 5), ("omegas", 6)]
    assert explained(out).count("split(") == 1


def results(spark):
    r = random.Random(5)
    skills = [f"s{k}" for k in range(40)] + ["é", "S1"]
    rows = []
    for i in range(300):
        both = r.sample(skills, r.randrange(20))
        cut = r.randrange(len(both) + 1)
        batch = None if i % 50 == 0 else f"b{i % 9 if i % 2 else i % 90}"
        rows.append((str(i), f"u{i % 4}", batch, i, f"Lead {i % 3} - x", both[:cut] + both[:1] * (cut > 0), None if i % 41 == 0 else both[cut:]))
    return spark.createDataFrame(rows, "id string, user_id string, batch_id string, seq long, job_title string, matching_skills array<string>,"
                                 " missing_skills array<string>").selectExpr("*", "CAST(NULL AS struct<is_fake_em:boolean,confidence:string,red_flags:array<string>>) AS fake_em_detection")


REPORTS = {
    "counts": insight.skill_counts, "users": lambda d: insight.skill_counts(d, "user_id"), "demand": insight.skill_demand,
    "all": lambda d: insight.skill_demand(d, None), "missing": insight.top_missing, "cut": lambda d: insight.top_missing(d, 3),
    "blocking": insight.blocking_skills, "batch": insight.batch_intelligence, "lists": insight.intelligence_lists,
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_of_large_and_small_batches_agree(spark, monkeypatch, name):
    df = results(spark)
    small = sorted(map(repr, REPORTS[name](df).collect()))
    for rows in (1, 6):
        monkeypatch.setattr(insight, "WHOLE_ROWS", rows)
        assert sorted(map(repr, REPORTS[name](df).collect())) == small


def test_skill_ranks_by_hand(spark):
    rows = [("1", "b", ["x"], ["y", "z"]), ("2", "b", ["y"], ["z"]), ("3", "b", ["z"], ["x", "x"]), ("4", "c", ["y"], None)]
    df = spark.createDataFrame(rows, "id string, batch_id string, matching_skills array<string>, missing_skills array<string>").selectExpr(
        "*", "'t' AS job_title", "CAST(NULL AS struct<is_fake_em:boolean,confidence:string,red_flags:array<string>>) AS fake_em_detection")
    assert sorted(map(tuple, insight.top_missing(df).select("batch_id", "skill", "jds", "rank").collect())) == [
        ("b", "x", 1, 2), ("b", "y", 1, 3), ("b", "z", 2, 1)]
    (one,) = insight.batch_intelligence(df, k=2).collect()
    assert [x["skill"] for x in one["top_required_skills"]] == ["z", "x"] and one["top_missing_from_profile"] == ["z", "x"]
    lists = [tuple(x) for x in insight.intelligence_lists(df).collect()]
    assert sorted(x for x in lists if x[1] == "missing") == [("b", "missing", 1, "z", 2), ("b", "missing", 2, "x", 1), ("b", "missing", 3, "y", 1)]
    assert sorted(x[2:4] for x in lists if x[1] == "required") == [(1, "z"), (2, "x"), (3, "y")]


def test_no_exploded_skill_is_shuffled(spark):
    """Lists move once, by batch; counts and ranks are made where they lie."""
    plan = insight.top_missing(results(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_folder_exports_are_divided_by_their_folders(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sinks, "FOLDERS_A_TASK", 20)
    df = spark.range(400).selectExpr(
        "concat('b', id % 200) AS batch_id", "id AS seq", "'c' AS company", "'t' AS job_title", "1 AS ats_score", "2 AS role_level_score",
        "cast(id as int) AS composite_score", "'REJECT' AS verdict", "'u' AS job_url", "array('r') AS hard_reject_reasons", "timestamp_ntz'2024-01-01' AS created_at")
    sinks.export_ranked_csv(df, f"{tmp_path}/ranked")
    sinks.export_batches_csv(df, f"{tmp_path}/batches", df.select("batch_id"))
    for folder in (tmp_path / "ranked" / "rows", tmp_path / "batches"):
        files = list(folder.glob("batch_id=*/part-*.csv"))
        assert len({f.parent for f in files}) == 200 and len({f.name.split("-")[1] for f in files}) >= 8
    text = "".join(f.read_text().partition("\n")[2] for f in sorted((tmp_path / "batches" / "batch_id=b7").glob("part-*.csv")))
    assert [line.split(",")[5] for line in text.splitlines()] == ["207", "7"]


def test_a_run_stores_its_rows_once_on_the_way(spark, tmp_path):
    """Rows are stored checked and in the table; which of them repeat is decided on ids."""
    df = spark.range(60).selectExpr(
        "CASE WHEN id % 10 = 9 THEN '7' ELSE cast(id as string) END AS id", "'u' AS user_id", "'b' AS batch_id", "'url' AS job_url", "'t' AS job_title",
        "'c' AS company", "repeat('x', 100) AS jd_text", "1 AS ats_score", "2 AS role_level_score", "3 AS composite_score",
        "CASE WHEN id = 4 THEN 'MAYBE' ELSE 'WEAK' END AS verdict", "array('r') AS hard_reject_reasons", "'{}' AS analysis_json",
        "timestamp_ntz'2024-01-01' AS created_at", "id AS extra")
    for run, part, kept in (("a", "extra < 40", 35), ("b", "extra >= 20", 18), ("b", "extra >= 20", 18)):
        with recorded() as paths:
            refused = sinks.append_run(df.where(part), f"{tmp_path}/table", run)
        assert [spark.read.parquet(p).columns for p in paths if "jd_text" not in spark.read.parquet(p).columns] == [["_row"]] and len(paths) == 2
        stored = sinks.stored_runs(spark, f"{tmp_path}/table", schemas.SCREENING).where(f"run = '{run}'")
        asked = df.where(part).count()
        assert (stored.count(), stored.select("id").distinct().count(), refused.count()) == (kept, kept, asked - kept)
        assert refused.columns == [*df.columns, "problems"]
    assert {x["problems"][0] for x in refused.collect()} == {"id is already stored"}


def test_answers_of_one_type_go_back_together():
    frames = [pd.DataFrame({"seq": [i], "status": pd.Series([200], dtype="int32"), "text": [None if i % 3 else "a"]}) for i in range(10)]
    frames[6] = frames[6].assign(seq=[None])
    out = list(scoring._together(iter(frames), most=4))
    assert [len(f) for f in out][:1] == [4] and len(out) < 7
    assert all(len({str(t) for t in f.dtypes}) == 3 and f["status"].dtype == "int32" for f in out if f["seq"].dtype == "int64" and len(f) > 1)
    assert [None if pd.isna(x) else int(x) for f in out for x in f["seq"]] == [0, 1, 2, 3, 4, 5, None, 7, 8, 9]
    assert list(scoring._together(iter([]))) == []
