"""Streams that carry quota, expire their state and add up counts."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from jobsift.operators import insight, matching, usage
from jobsift.plans import flows
from jobsift.streaming import streams
from test_scoring import JD, PROFILE

START = datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def people(spark):
    rules, likes = ([], "", [], [], []), ([], [], None, None, True)
    return spark.createDataFrame([(u, t, k, "cv", ["a"], rules, likes) for u, t, k in [
        ("f", "free", "k"), ("g", "free", "k"), ("p", "paid", "k"), ("n", "free", "")]], PROFILE)


def entered(spark):
    r = random.Random(3)
    out = []
    for i in range(160):
        user = r.choice(["f", "f", "g", "p", "n", "gone"])
        out.append((f"j{i:03d}", user, "" if i % 31 == 0 else f"{user}{i // 20}", i, None, "Engineer", None, " \n" if i % 17 == 0 else "some text", ["a", "b"],
                    START + timedelta(hours=9 * i)))
    return spark.createDataFrame(out, JD), len(out)


def test_admission_over_any_division_of_the_files(spark, tmp_path):
    jds, n = entered(spark)
    batch = flows.run_screening(jds, people(spark), [])
    want = rows(batch.results.select("id", "composite_score")), rows(batch.refused), rows(batch.usage)
    assert sum(r[3] == "over quota" for r in want[1]) > 3 and any(r[2] == 5 for r in want[2])
    stored = str(tmp_path / "profiles")
    matching.prepare_profiles(people(spark), "tier", "api_key_encrypted").write.parquet(stored)
    for name, cuts in (("one", [n]), ("three", [7, 80, n]), ("many", [*range(20, n, 20), n])):
        src, out, state = (str(tmp_path / f"{name}-{p}") for p in ("src", "out", "state"))
        begin = 0
        for end in cuts:
            jds.where((F.col("seq") >= begin) & (F.col("seq") < end)).coalesce(1).write.mode("append").parquet(src)
            begin = end
            streams.stream_admitted(streams.read_stream(spark, jds.schema, src), spark.read.parquet(stored), [], out, state).awaitTermination()
            if name == "many":
                streams.compact_parts(spark, f"{out}-used", ["user_id", "period"])
        got = (rows(spark.read.parquet(out).select("id", "composite_score")), rows(spark.read.parquet(f"{out}-refused").drop("epoch")),
               rows(streams.read_parts(spark, f"{out}-used", ["user_id", "period"], streams.USED)))
        assert got == want


def test_only_admitted_texts_meet_profiles(spark, tmp_path, monkeypatch):
    """Refused texts stay where they are read; ids that come twice bring the owners of both rows."""
    jds, _ = entered(spark)
    twice = jds.where("user_id = 'f' AND id > 'j150'").select("id").first()["id"]
    jds = jds.withColumn("id", F.when(F.col("id") == jds.where("user_id = 'p'").select("id").first()["id"], twice).otherwise(F.col("id"))).coalesce(1)
    src, out, state, stored = (str(tmp_path / p) for p in ("src", "out", "state", "profiles"))
    matching.prepare_profiles(people(spark), "tier", "api_key_encrypted").write.parquet(stored)
    jds.write.parquet(src)
    met, join = [], streams.with_profile
    monkeypatch.setattr(streams, "with_profile", lambda left, *rest, **more: (
        met.append(left.count() if "jd_text" in left.columns else 0), join(left, *rest, **more))[1])
    streams.stream_admitted(streams.read_stream(spark, jds.schema, src), spark.read.parquet(stored), [], out, state).awaitTermination()
    refused = {(r.id, r.user_id) for r in spark.read.parquet(f"{out}-refused").collect()}
    got = sorted((r.id, r.user_id) for r in spark.read.parquet(out).collect())
    assert got == sorted((r.id, r.user_id) for r in jds.collect() if (r.id, r.user_id) not in refused or r.id == twice)
    assert max(met) == len(got) and len(got) < jds.count() / 2


def test_state_of_days_expires(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "user_id string, ts timestamp, success boolean"
    days, late, held = 92, 0, []
    items = [(f"u{u}", START + timedelta(days=d, hours=u), u % 4 != 3) for d in range(days) for u in range(8)]
    for d in range(0, days, 4):
        part = [x for x in items if (x[1] - START).days in range(d, d + 4)]
        if d == 40:
            part += [("late", START + timedelta(days=1), True), ("late", START + timedelta(days=39), True)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        query = streams.update_to(streams.stream_daily_usage(streams.read_stream(spark, spark.read.parquet(src).schema, src)), out, state)
        query.awaitTermination()
        late += streams.late_rows(query)
        held.append(max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]))
    # One row is too late and is counted; the other one is not.  Six users of some days are held.
    assert late == 1 and max(held) <= 6 * 13 and max(held[15:]) <= max(held[3:10]) + 1
    folded = {(r.user_id, r.period.month): r.used for r in streams.usage_of_days(spark, out).collect()}
    whole = {(r.user_id, r.period.month): r.used for r in usage.monthly_usage(spark.createDataFrame(items, schema)).collect()}
    assert folded == {**whole, ("late", 2): 1}


def results(n):
    r = random.Random(8)
    skills = ["go", "sql", "k8s", "rust", "c"]
    return [(str(i), f"b{r.randrange(9)}", f"Dev {r.randrange(4)} - x", r.sample(skills, 2), r.sample(skills, r.randrange(4)),
             {"is_fake_em": r.random() < .3, "confidence": "high", "red_flags": [], "actual_level_assessment": ""}, START + timedelta(minutes=r.randrange(3000))) for i in range(n)]


RESULT = ("id string, batch_id string, job_title string, matching_skills array<string>, missing_skills array<string>, "
          "fake_em_detection struct<is_fake_em:boolean,confidence:string,red_flags:array<string>,actual_level_assessment:string>, created_at timestamp")


def test_intelligence_out_of_parts(spark, tmp_path):
    data = results(120)
    src, out, state, final = (str(tmp_path / n) for n in ("src", "out", "state", "final"))
    for i in range(0, 120, 15):
        spark.createDataFrame(data[i:i + 15], RESULT).coalesce(1).write.mode("append").parquet(src)
        streams.stream_parts(streams.read_stream(spark, spark.read.parquet(src).schema, src, max_files=1), out, state).awaitTermination()
        if i == 60:
            streams.compact_parts(spark, out, streams.PART_KEYS)
    df = spark.createDataFrame(data, RESULT)
    parts = streams.read_parts(spark, out, streams.PART_KEYS, streams.PARTS)
    assert rows(streams.intelligence_of_parts(parts)) == rows(insight.batch_intelligence(df))
    late = F.lit(START + timedelta(minutes=4000))
    first = streams.finalize_closed(spark, out, final, 1, late)
    assert rows(first) == rows(insight.batch_intelligence(df))
    # Given out once; again only the batch that got a row; a retried run gives the same.
    assert streams.finalize_closed(spark, out, final, 2, late).count() == 0
    more = [("x", "b3", "Dev 1 - x", ["go"], ["sql"], None, START)]
    spark.createDataFrame(more, RESULT).coalesce(1).write.mode("append").parquet(src)
    streams.stream_parts(streams.read_stream(spark, spark.read.parquet(src).schema, src), out, state).awaitTermination()
    both = df.union(spark.createDataFrame(more, RESULT))
    for _ in range(2):
        again = streams.finalize_closed(spark, out, final, 3, late)
        assert rows(again) == rows(insight.batch_intelligence(both).where("batch_id = 'b3'"))
    # At an early moment no batch has been quiet for long enough.
    assert streams.finalize_closed(spark, out, str(tmp_path / "early"), 1, F.lit(START)).count() == 0
    assert os.path.isdir(f"{final}/run=1")


def test_whole_lists_are_ranked(spark):
    df = spark.createDataFrame(results(200), RESULT)
    for whole, cut, item in ((insight.top_missing(df), insight.top_missing(df, 3), "skill"), (insight.title_patterns(df), insight.title_patterns(df, 3), "pattern")):
        got = whole.collect()
        by = {}
        for r in got:
            by.setdefault(r.batch_id, []).append((r["rank"], r.jds, r[item]))
        for ranked in by.values():
            ranked.sort()
            assert [x[0] for x in ranked] == list(range(1, len(ranked) + 1))
            assert [x[1:] for x in ranked] == sorted((x[1:] for x in ranked), key=lambda x: (-x[0], x[1]))
        assert rows(cut) == rows(whole.where("rank <= 3").select(*cut.columns))
    lists = insight.intelligence_lists(df)
    assert rows(lists.where("list = 'missing'").select("batch_id", F.col("item").alias("skill"), "jds", "rank")) == rows(
        insight.top_missing(df).select("batch_id", "skill", "jds", "rank"))


def kept_frames(monkeypatch):
    """The columns of the frames that are kept from here on."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, persist = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a, **b: (seen.append(self.columns), persist(self, *a, **b))[1])
    return seen


def test_texts_are_not_kept_while_a_trigger_runs(spark, tmp_path, monkeypatch):
    jds, _ = entered(spark)
    src, out, state, stored = (str(tmp_path / p) for p in ("src", "out", "state", "profiles"))
    matching.prepare_profiles(people(spark), "tier", "api_key_encrypted").write.parquet(stored)
    jds.write.parquet(src)
    kept = kept_frames(monkeypatch)
    streams.stream_admitted(streams.read_stream(spark, jds.schema, src), spark.read.parquet(stored), [], out, state).awaitTermination()
    assert kept and not any({"jd_text", "required_skills"} & set(c) for c in kept)
    want = flows.run_screening(jds, people(spark), [])
    assert rows(spark.read.parquet(out).select("id", "composite_score")) == rows(want.results.select("id", "composite_score"))


def test_skill_lists_are_not_kept_and_parts_move_once(spark, tmp_path, monkeypatch):
    at = F.timestamp_seconds(F.col("id") * 7)
    results = spark.range(0, 300, numPartitions=3).select(
        F.col("id").cast("string").alias("id"), (F.col("id") % 20).cast("string").alias("batch_id"), F.lit("Engineer").alias("job_title"),
        F.array(F.lit("a"), (F.col("id") % 7).cast("string")).alias("matching_skills"), F.array((F.col("id") % 3).cast("string")).alias("missing_skills"),
        F.struct(F.lit(True).alias("is_fake_em"), F.lit("high").alias("confidence")).alias("fake_em_detection"), at.alias("created_at"))
    src, out, state, final = (str(tmp_path / p) for p in ("src", "out", "state", "final"))
    results.write.parquet(src)
    kept = kept_frames(monkeypatch)
    streams.stream_parts(streams.read_stream(spark, results.schema, src, max_files=1), out, state).awaitTermination()
    assert kept and not any({"matching_skills", "missing_skills"} & set(c) for c in kept)
    added = []
    monkeypatch.setattr(streams, "intelligence_of_parts", lambda parts, f=streams.intelligence_of_parts: (added.append(parts), f(parts))[1])
    monkeypatch.setattr(streams, "PARTS_A_TASK", 40)
    done = streams.finalize_closed(spark, out, final, 1, F.lit(datetime(2030, 1, 1)))
    names = ["batch_id", "total_jds", "top_missing_from_profile"]
    assert rows(done.select(*names)) == rows(insight.batch_intelligence(results).select(*names)) and done.count() == 20
    # The parts are divided by batch as they are, finely enough for a task.
    plan = added[0].where("kind = 'skill'")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(batch_id" in plan and "REPARTITION_BY_NUM" in plan
