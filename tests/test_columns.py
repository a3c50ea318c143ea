"""Column functions on hand-written values."""

from pyspark.sql import functions as F

from jobsift.functions import profiles as pf
from jobsift.functions import scores, text
from jobsift.schemas import FILTERS, PREFERENCES


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_trim_strips_unicode_space(spark):
    rows = [("  a b﻿\n",), ("　",), ("x\u0085",), (None,)]
    got = values(spark, rows, "c string", text.js_trim(F.col("c")), text.is_blank(F.col("c")))
    assert got == [("a b", False), ("", True), ("x\u0085", False), (None, True)]


def test_word_count_splits_on_unicode_space(spark):
    rows = [("a b  c\n",), ("",), (" ",), ("one",)]
    assert values(spark, rows, "c string", text.word_count(F.col("c"))) == [(3,), (0,), (0,), (1,)]


def test_valid_urls(spark):
    pasted = " http\nexample.com/x\nexample com\n\n-a.b\n.com\nhttps://a b\n"
    assert one(spark, text.count_valid_urls(F.lit(pasted))) == 4
    assert one(spark, text.count_valid_urls(F.lit(None).cast("string"))) == 0


def test_normalize_job_url(spark):
    rows = [
        ("https://www.linkedin.com/jobs/collections/?currentJobId=42&x=1",),
        ("https://WWW.LinkedIn.com/jobs?currentJobId=7",),
        ("https://www.linkedin.com/jobs?currentJobId=",),
        ("https://www.linkedin.com/jobs?other=1",),
        ("https://example.com/?currentJobId=42",),
        ("not a url ?currentJobId=1",),
        ("linkedin.com/jobs?currentJobId=1",),
        ("https://x.org/?u=linkedin.com&currentJobId=1",),
        ("https://www.linkedin.com/jobs?q=a b|c&currentJobId=4%32&currentJobId=9#currentJobId=8",),
        ("https://www.linkedin.com/jobs?notcurrentJobId=1",),
        ("https://www.linkedin.com/jobs#?currentJobId=1",),
    ]
    got = [r[0] for r in values(spark, rows, "c string", text.normalize_job_url(F.col("c")))]
    assert got == [
        "https://www.linkedin.com/jobs/view/42/",
        "https://www.linkedin.com/jobs/view/7/",
        "https://www.linkedin.com/jobs/view//",
        *[rows[i][0] for i in range(3, 8)],
        "https://www.linkedin.com/jobs/view/42/",
        rows[9][0], rows[10][0],
    ]


def test_text_problem_boundaries(spark):
    rows = [("\x01" * 3 + "a" * 17,), ("\x01" * 4 + "a" * 17,), ("a" * 50_000,), ("a" * 50_001,), (" \n",), ("\t\n\r ok",)]
    got = [r[0] for r in values(spark, rows, "c string", text.text_problem(F.col("c")))]
    assert got[0] is None and "binary" in got[1] and got[2] is None
    assert "50,000" in got[3] and "empty" in got[4] and got[5] is None


def test_lists_and_tags(spark):
    assert one(spark, text.parse_list(F.lit(" a, ,b ,, c"))) == ["a", "b", "c"]
    assert one(spark, text.join_list(F.array(F.lit("a"), F.lit("b")))) == "a, b"
    added = text.add_tags(F.array(F.lit("a")), F.array(*map(F.lit, [" a ", "b", "", "b ", "c"])))
    assert one(spark, added) == ["a", "b", "c"]


def test_normalize_terms_keeps_symbols(spark):
    got = one(spark, text.normalize_terms(F.lit("We use .NET, C++/C#; Node.js. End..")))
    assert got == " we use .net c++ c# node.js end "


def test_code_fence(spark):
    rows = [('```json\n{"a":1}\n```\n',), ('```JSON {"a":1}```',), ('{"a":1}',), ('``` {"a":1} ``` ',)]
    got = values(spark, rows, "c string", text.strip_code_fence(F.col("c")))
    assert got == [('{"a":1}',)] * 4


# Scores of the five sample shapes: ats, role, composite, verdict.
SAMPLES = [
    (82, 88, 85, "STRONG"), (71, 79, 75, "DECENT"), (65, 80, 73, "DECENT"),
    (44, 58, 52, "WEAK"), (0, 0, 0, "REJECT"),
]


def test_samples(spark):
    rows = [(a, r, v == "REJECT") for a, r, _, v in SAMPLES]
    c = scores.composite_score(F.col("a"), F.col("r"))
    got = values(spark, rows, "a int, r int, x boolean", c, scores.verdict(c, F.col("x")))
    assert got == [(c, v) for _, _, c, v in SAMPLES]


def test_why_verdict(spark):
    rows = [
        ("STRONG", 82, 88, ["x", "y"], []), ("DECENT", 71, 79, ["x"], []), ("DECENT", 65, 80, ["a", "b"], []),
        ("DECENT", 65, 80, [], []), ("DECENT", 80, 65, [], []), ("WEAK", 44, 58, [], []),
        ("WEAK", 44, 44, [], []), ("WEAK", 60, 50, [], []), ("REJECT", 0, 0, [], ["too far"]),
        ("REJECT", 0, 0, None, None), ("OTHER", 1, 1, [], []),
    ]
    got = [r[0] for r in values(
        spark, rows, "v string, a int, r int, m array<string>, h array<string>",
        scores.why_verdict(*map(F.col, "varmh")))]
    assert got == [
        "STRONG: skills (82) and level (88) are both where they should be.",
        "DECENT: the level suits well (79), yet 1 required skill absent, ATS only 71.",
        "DECENT: the level suits well (80), yet 2 required skills absent, ATS only 65.",
        "DECENT: the level suits well (80), yet the ATS score of 65 is middling.",
        "DECENT: the skills mostly match (80), the level (65) only in part.",
        "WEAK: too few of the skills match (44), although the level may do (58).",
        "WEAK: neither the skills (44) nor the level (44) reach what is needed.",
        "WEAK: the level is far off (50).",
        "REJECT without a score: it breaks the rule too far.",
        "REJECT without a score: it breaks one of your rules.",
        "",
    ]


def test_reason_line(spark):
    rows = [
        ("REJECT", ["r"], "h", "APPLY now"), ("REJECT", [], "h", None), ("WEAK", [], "h" * 91, None),
        ("WEAK", [], "h" * 90, None), ("WEAK", [], "", "apply if \n you like"), ("WEAK", [], None, "SKIPPER"),
        ("WEAK", [], None, None), ("WEAK", [], None, "Maybe"),
    ]
    got = [r[0] for r in values(
        spark, rows, "v string, h array<string>, l string, r string", scores.reason_line(*map(F.col, "vhlr")))]
    assert got == ["r", "Breaks a rule", "h" * 90 + "…", "h" * 90, "you like", "PER", "", "Maybe"]


def test_small_scores(spark):
    assert [one(spark, scores.time_saved(F.lit(n))) for n in (0, 1, 4, 5, 6, 10)] == [
        "0 min", "12 min", "48 min", "1 hr", "1 hr 12 min", "2 hr"]
    assert [one(spark, scores.score_band(F.lit(n))) for n in (49, 50, 69, 70)] == ["red", "amber", "amber", "green"]
    assert [one(spark, scores.verdict_label(F.lit(x))) for x in ("WEAK", "weak")] == ["Low Priority", "Unknown"]
    assert [one(spark, scores.recommendation_action(F.lit(x))) for x in ("APPLY IF a", "APPLY", "Skip", "SKIP.")] == [
        "APPLY IF", "APPLY", None, "SKIP"]
    assert one(spark, scores.score_breakdown(F.lit("WEAK"), F.lit(44), F.lit(58), F.lit(52))) == (
        "Composite 52 = (ATS 44 × 0.45) + (Role 58 × 0.55) = 51.7")
    assert one(spark, scores.score_breakdown(F.lit("REJECT"), F.lit(0), F.lit(0), F.lit(0))) is None
    ranks = [one(spark, scores.seniority_rank(F.lit(t))) for t in ("Senior Engineering Manager", "Engineer", "VP, Data")]
    assert ranks == [7, None, 9]


def test_inflated_manager(spark):
    rows = [((True, "high"),), ((True, "medium"),), ((True, "low"),), ((True, None),), ((None, "high"),), ((False, "high"),), (None,)]
    got = values(spark, rows, "d struct<is_fake_em boolean, confidence string>", scores.inflated_manager(F.col("d")))
    assert [g[0] for g in got] == [True, True, False, False, False, False, False]


def profile(spark, filters, prefs, key=None, resume=None):
    schema = f"f {FILTERS.simpleString()}, p {PREFERENCES.simpleString()}, k string, r string"
    return spark.createDataFrame([(filters, prefs, key, resume)], schema)


EMPTY_FILTERS = ([], "", [], [], [])
EMPTY_PREFS = ([], [], None, None, None)


def test_profile_columns(spark):
    f, p, k, r = map(F.col, "fpkr")
    full = profile(spark, (list("abcdef"), " Lead", ["x", "y", "z"], ["q"], ["s", "t", "u"]),
                   (["J", "K"], ["fin"], 0, None, False), "key", " ")
    got = full.select(
        pf.active_rules(f), pf.completeness(p, f, k), pf.next_action(p, f, k), pf.is_new_user(r, k, p),
        pf.effective_resume(r, p, f)).first()
    assert got[0] == ["a", "b", "c", "d", "+2 more", "Below  Lead", "Outside x/y", "q", "s", "t"]
    assert got[1:4] == (100, None, False)
    assert got[4] == "Technical skills: J, K\nIndustries: fin\nSeniority:  Lead\nPreferred locations: x, y, z"
    empty = profile(spark, EMPTY_FILTERS, EMPTY_PREFS)
    got = empty.select(pf.active_rules(f), pf.completeness(p, f, k), pf.is_new_user(r, k, p),
                       pf.has_preferences(p, f), pf.effective_resume(r, p, f)).first()
    assert tuple(got) == ([], 0, True, False, "")
    nulls = profile(spark, None, None)
    got = nulls.select(pf.active_rules(f), pf.completeness(p, f, k), pf.is_new_user(r, k, p),
                       pf.has_preferences(p, f), pf.effective_resume(r, p, f)).first()
    assert tuple(got) == ([], 0, True, False, "")
    # A size of 0 fills the preferences, yet counts as nothing for a new user.
    zero = profile(spark, EMPTY_FILTERS, ([], [], 0, None, None))
    got = zero.select(pf.completeness(p, f, k), pf.completeness_band(F.lit(80)), pf.is_new_user(r, k, p)).first()
    assert tuple(got) == (40, "green", True)
