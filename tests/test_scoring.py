"""A scorer is asked no item in vain: fatal answers, allowances, waves, and whole runs."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsift.operators import matching, scoring
from jobsift.plans import flows

ANSWER = "batch_id string, seq long, status int, asked string"
START = datetime(2024, 1, 1)


def counting(folder):
    """A scorer that answers with the status in ``jd_text`` and leaves a file per question."""
    def scorer(frames):
        for frame in frames:
            assert len(frame) == 1
            row = frame.iloc[0]
            with open(os.path.join(folder, f"{row.batch_id}~{row.seq}"), "x"):
                pass
            yield frame.assign(status=int(row.jd_text), asked="x")[["batch_id", "seq", "status", "asked"]].astype({"status": "int32"})
    return scorer


def in_order(rows):
    """Which items are asked, one after another."""
    asked, stopped, used = [], set(), Counter()
    first = {}
    for r in rows:
        first[r[0]] = min(first.get(r[0], r[3]), r[3])
    for batch, seq, user, ts, period, left, text in sorted(rows, key=lambda r: (first[r[0]], r[0], r[1])):
        if batch in stopped or (left is not None and used[user, period] >= left):
            continue
        asked.append((batch, seq))
        if text in ("401", "429"):
            stopped.add(batch)
        elif text == "200":
            used[user, period] += 1
    return asked


@pytest.mark.parametrize("wave_rows", [scoring.WAVE_ROWS, 7])
def test_nothing_is_asked_in_vain(spark, tmp_path, wave_rows):
    r = random.Random(wave_rows)
    rows = []
    for u in range(12):
        left = None if u % 3 == 0 else r.choice([0, 1, 5])
        for b in range(r.randint(1, 4)):
            for seq in range(r.choice([1, 4, 30])):
                at = START + timedelta(days=9 * b, minutes=seq)
                rows.append((f"u{u}b{b}", seq, f"u{u}", at, datetime(at.year, at.month, 1), left, r.choice(["200"] * 12 + ["500", "500", "401", "429"])))
    items = spark.createDataFrame(rows, "batch_id string, seq long, user_id string, ts timestamp, period timestamp, left int, jd_text string")
    answers = scoring.ask_in_order(items.repartition(5), counting(str(tmp_path)), ANSWER, ["batch_id", "seq", "jd_text"], wave_rows=wave_rows)
    got = [(x.batch_id, x.seq) for x in answers.collect()]
    want = in_order(rows)
    assert sorted(got) == sorted(want)
    # No question but these, and none twice.
    assert sorted(os.listdir(tmp_path)) == sorted(f"{b}~{s}" for b, s in want)
    everything = matching.score_with(items.select("batch_id", "seq", "jd_text"), lambda frames: (
        f.assign(status=f.jd_text.astype("int32"))[["batch_id", "seq", "status"]] for f in frames), "batch_id string, seq long, status int")
    unlimited = items.where("left IS NULL").select("batch_id").distinct()
    judged = [matching.until_fatal(d.withColumn("outcome", F.when(F.col("status").isin(401, 429), "invalid_key").otherwise("ok"))).join(
        unlimited, "batch_id", "left_semi").select("batch_id", "seq").collect() for d in (answers, everything)]
    assert sorted(judged[0]) == sorted(judged[1])
    assert scoring.ask_in_order(items.where("false"), counting(str(tmp_path)), ANSWER, ["batch_id", "seq", "jd_text"]).count() == 0


PROFILE = ("id string, tier string, api_key_encrypted string, resume_text string, profile_skills array<string>, "
           "hard_reject_filters struct<tech_stack_dealbreakers:array<string>,title_floor:string,geography_allowed:array<string>,"
           "company_type_excluded:array<string>,role_type_excluded:array<string>>, preferences struct<preferred_tech_stack:array<string>,"
           "target_industries:array<string>,min_company_size:int,max_company_size:int,onboarding_completed:boolean>")
JD = ("id string, user_id string, batch_id string, seq long, job_url string, job_title string, company string, jd_text string, "
      "required_skills array<string>, created_at timestamp")


def people(spark):
    rules, likes = ([], "", [], [], []), ([], [], None, None, True)
    return spark.createDataFrame([
        ("free", "free", "k", "cv", ["a"], rules, likes), ("paid", "paid", "k", "cv", ["a"], rules, likes), ("nokey", "paid", "", "cv", [], rules, likes)], PROFILE)


def entered(spark, rows):
    return spark.createDataFrame([(f"{b}{s}", u, b, s, None, "Engineer", None, t, ["a", "b"], START + timedelta(minutes=m)) for u, b, s, t, m in rows], JD)


def test_native_runs_admit_five_together(spark):
    first = entered(spark, [("free", "x", i, "text", i) for i in range(3)] + [("paid", "p", i, "text", i) for i in range(9)]
                    + [("nokey", "n", 0, "text", 0), ("gone", "g", 0, "text", 0), ("paid", "", 5, "text", 0), ("paid", "p", 20, " \n", 0)])
    second = entered(spark, [("free", "y", i, "text", 100 + i) for i in range(6)])
    one = flows.run_screening(first, people(spark), [])
    used = {(r.user_id, r.used) for r in one.usage.collect()}
    assert used == {("free", 3), ("paid", 9)}
    assert sorted(r.reason for r in one.refused.collect()) == ["no batch", "no key", "no profile", "no text"]
    two = flows.run_screening(second, people(spark), [], used_before=one.usage)
    assert sorted(r.id for r in two.results.collect()) == ["y0", "y1"]
    assert sorted((r.id, r.reason) for r in two.refused.collect()) == [(f"y{i}", "over quota") for i in range(2, 6)]
    assert one.results.count() == 12 and one.fatal.count() == 0
    both = flows.run_screening(first.union(second), people(spark), [])
    assert sorted(r.id for r in both.results.collect()) == sorted([r.id for r in one.results.collect()] + ["y0", "y1"])


def answering():
    """A scorer whose answer's status stands in the text."""
    def answers(frames):
        for frame in frames:
            row = frame.iloc[0]
            status = int(row.jd_text)
            yield frame[["batch_id", "seq", "jd_text"]].assign(
                id=f"r{row.batch_id}{row.seq}", job_title=None, company=None, ats_score=np.int32(50), role_level_score=np.int32(50), composite_score=np.int32(50), verdict="WEAK",
                hard_reject_reasons=[[]], status=np.int32(status), detail_items=None, detail=None, error="bad" if status > 299 else None, status_text=None)
    return answers


ANSWERED = ("batch_id string, seq long, id string, job_title string, company string, jd_text string, ats_score int, role_level_score int, composite_score int, "
            "verdict string, hard_reject_reasons array<string>, status int, detail_items array<struct<loc:array<string>,msg:string>>, detail string, error string, status_text string")


def test_runs_with_a_scorer(spark):
    rows = [("free", "x", i, t, i) for i, t in enumerate(["200", "500", "200", "200"])] + [("free", "y", i, "200", 50 + i) for i in range(4)]
    rows += [("paid", "p", i, t, i) for i, t in enumerate(["200", "429", "200", "401"])] + [("nokey", "n", 0, "200", 0)]
    run = flows.run_screening_with(entered(spark, rows), people(spark), answering(), ANSWERED)
    results = {(r.batch_id, r.seq): r.verdict for r in run.results.collect()}
    assert results == {("x", 0): "WEAK", ("x", 1): "REJECT", ("x", 2): "WEAK", ("x", 3): "WEAK", ("y", 0): "WEAK", ("y", 1): "WEAK", ("p", 0): "WEAK"}
    assert sorted((r.id, r.reason) for r in run.refused.collect()) == [
        ("n0", "no key"), ("p2", "stopped"), ("p3", "stopped"), ("y2", "over quota"), ("y3", "over quota")]
    assert [(r.batch_id, r.seq, r.type, r.message) for r in run.fatal.collect()] == [("p", 1, "rate_limit", "bad")]
    assert {(r.user_id, r.used) for r in run.usage.collect()} == {("free", 5), ("paid", 1)}
    later = flows.run_screening_with(entered(spark, [("free", "z", 0, "200", 99)]), people(spark), answering(), ANSWERED, used_before=run.usage)
    assert later.results.count() == 0 and [r.reason for r in later.refused.collect()] == ["over quota"]
