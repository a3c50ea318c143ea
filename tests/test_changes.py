"""Change sets, tracking, deletes and result assembly on small tables."""

import pytest
from pyspark.sql import functions as F

from jobsift.operators import changes, history, insight, matching, usage


def make(spark, rows, schema):
    """A small frame; columns of type ``ts`` are given as text."""
    fields = [part.rsplit(" ", 1) for part in schema.split(", ")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if t == 'ts' else t}" for n, t in fields))
    times = [n for n, t in fields if t == "ts"]
    return df.withColumns({n: F.to_timestamp(n) for n in times}) if times else df


def test_track_returns_existing_or_inserts_once(spark):
    tracker = make(spark, [("t1", "u", "r1", "old", "Offer")],
                   "id string, user_id string, screening_result_id string, job_title string, status string")
    asked = make(spark, [
        (1, "u", "r1", "a"), (2, "u", "r2", "b"), (3, "u", "r2", "c"), (4, "u", None, "d"), (5, "u", "", "e"), (6, "v", "r1", "f"),
    ], "request_id int, user_id string, screening_result_id string, job_title string").withColumns(
        {"company": F.lit("x"), "job_url": F.lit("y")})
    inserts, existing = changes.track(asked, tracker, F.to_timestamp(F.lit("2024-01-01")))
    got = sorted((r["id"], r["screening_result_id"], r["job_title"], r["status"]) for r in inserts.collect())
    assert got == [("2", "r2", "b", "Applied"), ("4", None, "d", "Applied"), ("5", None, "e", "Applied"), ("6", "r1", "f", "Applied")]
    assert [r["id"] for r in existing.collect()] == ["t1"]


def test_tracked_flag(spark):
    results = make(spark, [("r1", "u"), ("r2", "u"), ("r1x", "v")], "id string, user_id string")
    tracker = make(spark, [("u", "r1"), ("u", "r1"), ("v", "r2"), ("u", None)], "user_id string, screening_result_id string")
    got = {r["id"]: r["tracked"] for r in changes.with_tracked_flag(results, tracker).collect()}
    assert got == {"r1": True, "r2": False, "r1x": False}


def test_profile_patch(spark):
    base = make(spark, [("a", "Ann", "text", "k0", "openai", "2024-01-01"), ("b", "Bob", "t", None, "openai", "2024-01-01")],
                "id string, full_name string, resume_text string, api_key_encrypted string, api_provider string, updated_at ts")
    patches = make(spark, [
        (1, "a", "2024-02-01", None, True, "new", True, "anthropic", False, "k1"),
        (2, "a", "2024-02-02", "Anna", False, None, False, None, False, ""),
        (3, "zz", "2024-02-02", "No", True, None, False, None, False, None),
    ], "patch_id int, user_id string, ts ts, full_name string, has_full_name boolean, resume_text string,"
       " has_resume_text boolean, api_provider string, has_api_provider boolean, api_key_encrypted string")
    out = changes.apply_profile_patch(base, patches, ("full_name", "resume_text", "api_provider"))
    got = {r["id"]: tuple(r)[1:5] + (str(r["updated_at"].date()),) for r in out.collect()}
    assert got == {"a": (None, "new", "k1", "openai", "2024-02-02"), "b": ("Bob", "t", None, "openai", "2024-01-01")}


def test_tracker_updates(spark):
    tracker = make(spark, [("t", "u", "Applied", "n", "2024-01-01")], "id string, user_id string, status string, notes string, updated_at ts")
    updates = make(spark, [
        (1, "t", "u", "Offer", None, False, "2024-02-01"), (2, "t", "u", None, None, True, "2024-02-02"),
        (3, "t", "u", "Hired", "x", True, "2024-02-03"),
    ], "update_id int, id string, user_id string, status string, notes string, has_notes boolean, ts ts")
    new, refused = changes.apply_tracker_updates(tracker, updates)
    row = new.first()
    assert (row["status"], row["notes"], str(row["updated_at"].date())) == ("Offer", None, "2024-02-02")
    assert [r["update_id"] for r in refused.collect()] == [3]


def test_payment_events(spark):
    people = make(spark, [("1", "a@x", "free"), ("2", "b@x", "paid"), ("3", "c@x", "free"), ("4", "d@x", "paid")],
                  "id string, email string, tier string")
    def body(event, part, note):
        return '{"event":"%s","payload":{"%s":{"entity":{"notes":%s}}}}' % (event, part, note)
    events = make(spark, [
        (1, "2024-01-01", body("payment.captured", "payment", '{"user_email":"a@x"}')),
        (2, "2024-01-03", body("subscription.cancelled", "subscription", '{"user_email":"b@x"}')),
        (3, "2024-01-02", body("payment.captured", "payment", '{"user_email":"b@x"}')),
        (4, "2024-01-01", body("payment.captured", "payment", '{"other":"c@x"}')),
        (5, "2024-01-01", body("payment.captured", "subscription", '{"user_email":"c@x"}')),
        (6, "2024-01-01", body("order.paid", "payment", '{"user_email":"c@x"}')),
        (7, "2024-01-01", "broken"),
    ], "event_id int, ts ts, body string")
    out = usage.apply_payment_events(people, usage.decode_payment_events(events))
    assert {r["id"]: r["tier"] for r in out.collect()} == {"1": "paid", "2": "free", "3": "free", "4": "paid"}


def test_confirm_orders(spark):
    people = make(spark, [("1", "free", "o1"), ("2", "free", "o2"), ("3", "free", None)], "id string, tier string, pending_order_id string")
    paid = make(spark, [("p1", "1", "o1"), ("p2", "2", "o1"), ("p3", "3", None)], "payment_id string, user_id string, order_id string")
    owned = changes.owned_orders(paid, people)
    assert [r["payment_id"] for r in owned.collect()] == ["p1"]
    got = {r["id"]: (r["tier"], r["pending_order_id"]) for r in usage.confirm_orders(people, owned).collect()}
    assert got == {"1": ("paid", None), "2": ("free", "o2"), "3": ("free", None)}


def test_deletes(spark):
    results = make(spark, [("r1", "a"), ("r2", "b")], "id string, user_id string")
    tracker = make(spark, [("t1", "a", "r1", "kept"), ("t2", "b", "r2", "kept"), ("t3", "b", None, "kept")],
                   "id string, user_id string, screening_result_id string, company string")
    left, links = changes.delete_results(make(spark, [("r1",)], "id string"), results, tracker)
    assert [r["id"] for r in left.collect()] == ["r2"]
    assert sorted((r["id"], r["screening_result_id"], r["company"]) for r in links.collect()) == [
        ("t1", None, "kept"), ("t2", "r2", "kept"), ("t3", None, "kept")]
    people = make(spark, [("a",), ("b",)], "id string")
    out = changes.delete_profiles(make(spark, [("b",)], "id string"), people, results=results, tracker=tracker)
    assert {k: sorted(r["id"] for r in v.collect()) for k, v in out.items()} == {
        "profiles": ["a"], "results": ["r1"], "tracker": ["t1"]}


def test_duplicates_on_company_and_title(spark):
    rows = make(spark, [
        ("1", "u", "A", "x", "2024-01-01"), ("2", "u", "A", "x", "2024-01-02"), ("3", "u", "A", "y", "2024-01-01"),
        ("4", "u", None, "x", "2024-01-01"), ("5", "u", None, "x", "2024-01-03"), ("6", "v", "A", "x", "2024-01-01"),
        ("7", "u", "a", "x", "2024-01-01"), ("8", "u", "A", "x", "2024-01-02"),
    ], "id string, user_id string, company string, job_title string, created_at ts")
    got = {r["id"]: r["is_duplicate"] for r in history.flag_duplicates(rows).collect()}
    assert [i for i in sorted(got) if got[i]] == ["1", "4", "8"]


def test_history_filter(spark):
    rows = make(spark, [("1", "WEAK", "Acme", None), ("2", "WEAK", None, "At ACME"), ("3", "STRONG", None, None), ("4", "WEAK", "x%y", "z")],
                "id string, verdict string, company string, job_title string")
    def ids(*args):
        return sorted(r["id"] for r in history.filter_history(rows, *args).collect())
    assert ids() == ["1", "2", "3", "4"] and ids("WEAK", " aCmE ") == ["1", "2"] and ids("STRONG", "acme") == []
    assert ids("ALL", "%") == ["4"]


def test_section_order(spark):
    rows = make(spark, [("b", 1, "", "REJECT", 0), ("b", 2, "x", "REJECT", 0), ("b", 3, "y", "WEAK", 40),
                        ("b", 4, "z", "STRONG", 90), ("b", 5, "", "REJECT", 0), ("b", 6, "w", "WEAK", 40)],
                "batch_id string, seq int, id string, verdict string, composite_score int")
    assert [r["seq"] for r in history.section_results(rows).collect()] == [4, 3, 6, 1, 5, 2]
    assert [r["seq"] for r in history.sort_results(rows, "verdict").collect()] == [4, 3, 6, 1, 2, 5]
    with pytest.raises(ValueError):
        history.sort_results(rows, "company")


def test_outcome_messages(spark):
    rows = spark.createDataFrame([
        (200, None, None, None, "OK"), (401, None, "no key", "e", "s"), (429, None, None, "slow", "s"),
        (422, [(["body", "jd"], "bad"), ([], "worse")], None, None, "s"), (500, None, None, None, "Server Error"),
    ], "status int, detail_items array<struct<loc array<string>, msg string>>, detail string, error string, status_text string")
    got = [(r["outcome"], r["message"]) for r in matching.classify_outcome(rows).collect()]
    assert got == [("ok", None), ("invalid_key", "no key"), ("rate_limit", "slow"),
                   ("item_error", "jd: bad, undefined: worse"), ("item_error", "Server Error")]


def test_skill_lists_keep_spelling(spark):
    jds = spark.createDataFrame([("1", "u", ["Java", "SQL", "Go", "Java"]), ("2", "u", ["java", "go"]), ("3", "u", [])],
                                "id string, user_id string, required_skills array<string>")
    people = spark.createDataFrame([("u", ["JAVA", "Sql"], None)], "id string, profile_skills array<string>,"
                                   " hard_reject_filters struct<tech_stack_dealbreakers:array<string>,title_floor:string,"
                                   "geography_allowed:array<string>,company_type_excluded:array<string>,role_type_excluded:array<string>>")
    got = {r["id"]: (r["matching_skills"], r["missing_skills"], r["ats_score"]) for r in matching.ats_coverage(jds, people).collect()}
    assert got == {"1": (["Java", "SQL"], ["Go"], 67), "2": (["java"], ["go"], 50), "3": ([], [], 0)}
    weights = spark.createDataFrame([("java", 3), ("Go", 1)], "skill string, weight int")
    got = {r["id"]: r["ats_score"] for r in matching.ats_coverage(jds, people, weights).collect()}
    assert got == {"1": 80, "2": 75, "3": 0}


def test_intelligence(spark):
    rows = spark.createDataFrame([
        ("b", "1", "Lead Dev — Remote", ["java"], ["go"], (True, "high")), ("b", "2", "lead dev", ["java"], ["go", "k8s"], (True, "low")),
        ("b", "3", "VP", [], ["go"], None), ("small", "4", "x", ["java"], [], None),
    ], "batch_id string, id string, job_title string, matching_skills array<string>, missing_skills array<string>,"
       " fake_em_detection struct<is_fake_em:boolean,confidence:string>")
    out = insight.batch_intelligence(rows).collect()
    assert len(out) == 1
    row = out[0]
    assert (row["total_jds"], row["red_flags_count"]) == (3, 1)
    assert [tuple(s) for s in row["top_required_skills"]] == [
        ("go", 3, 100.0, "high_demand"), ("java", 2, 66.7, "high_demand"), ("k8s", 1, 33.3, "moderate")]
    assert row["top_missing_from_profile"] == ["go", "k8s"] and row["title_patterns"] == ["lead dev", "vp"]
