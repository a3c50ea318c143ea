"""The skew helpers give the same answer whether or not keys count as hot."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from compare import connect, differences
from jobsift import skew
from jobsift.operators import history, matching, usage
from jobsift.plans.oracle import ORACLE
from jobsift.plans.queries import QUERIES


@pytest.fixture(scope="module")
def left(spark):
    # A third of the rows share one key, some have none.
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"))


@pytest.fixture(scope="module")
def right(spark):
    return spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("min_rows", [1, 500, 10**9])
def test_spread_join_equals_join(left, right, how, min_rows):
    plain = left.join(right, ["k"], how)
    spread = skew.spread_join(left, right, ["k"], how, ["id"], min_rows=min_rows)
    assert rows(spread.select(*plain.columns)) == rows(plain)


def test_hot_keys_finds_the_giant(left):
    assert [r["k"] for r in skew.hot_keys(left, ["k"], min_rows=500).collect()] == [7]


def test_hot_rows_are_split(left, right):
    joined = skew.spread_join(
        left.where("k = 7"), right, ["k"], "inner", ["id"], min_rows=500)
    assert joined.count() == left.where("k = 7").count()
    salts = skew.hot_keys(left, ["k"], min_rows=10).where("k = 7").first()["salts"]
    assert salts >= 200  # a key of 100 times the threshold: half the threshold per salt
    sizes = [r["n"] for r in left.where("k = 7").groupBy(skew.salt_of(["id"], salts).alias("s")).agg(
        F.count("*").alias("n")).collect()]
    assert len(sizes) > 190 and max(sizes) < 25


def test_positions_of_null_values(spark):
    rows_in = [("a", 1, 5), ("a", 2, None), ("a", 3, 7), ("b", 4, None)]
    df = spark.createDataFrame(rows_in, "batch_id string, seq long, composite_score int")
    got = {(r["batch_id"], r["seq"]): r["position"] for r in history.rank_results(df).collect()}
    assert got == {("a", 3): 1, ("a", 1): 2, ("a", 2): 3, ("b", 4): 1}


def test_rows_without_a_link_are_not_brought_together(spark):
    from jobsift.operators import changes

    tracker = spark.range(2000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") < 10, F.col("id").cast("string")).alias("screening_result_id"))
    results = spark.range(20).select(F.col("id").cast("string").alias("id"))
    _, left_over = changes.delete_results(results.where("id < 5"), results, tracker)
    assert left_over.count() == 2000 and left_over.where("screening_result_id IS NOT NULL").count() == 5


@pytest.mark.parametrize("k", [1, 5, 2000])
def test_top_k(left, k):
    order = [F.col("id").desc()]
    want = left.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order))).where(F.col("rank") <= k)
    assert rows(skew.top_k(left, ["k"], order, k, ["id"])) == rows(want)


def test_latest_per_key(left):
    got = skew.latest_per_key(left.withColumn("ts", F.col("id") % 10), ["k"], ["ts", "id"])
    want = left.withColumn("ts", F.col("id") % 10).withColumn(
        "r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("ts"), F.desc("id")))).where("r = 1")
    assert rows(got.select("k", "id", "ts")) == rows(want.select("k", "id", "ts"))


def test_position_in_group(left, monkeypatch):
    df = left.where("k is not null").select(
        F.col("k").cast("string").alias("batch_id"), F.col("id").alias("seq"),
        (F.col("id") * 31 % 11).cast("int").alias("composite_score"))
    monkeypatch.setattr(history, "BIG_GROUP_SPAN", 64)
    got = history.rank_results(df)
    w = Window.partitionBy("batch_id").orderBy(F.desc("composite_score"), "seq")
    want = df.withColumn("position", F.row_number().over(w))
    assert rows(got.select(*want.columns)) == rows(want)


def test_until_fatal_with_hot_batch(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    items = spark.createDataFrame(
        [("a", 1, "ok"), ("a", 2, "item_error"), ("a", 3, "rate_limit"), ("a", 4, "ok"), ("a", 5, "invalid_key"),
         ("b", 1, "invalid_key"), ("b", 2, "ok"), ("c", 1, "ok")], "batch_id string, seq int, outcome string")
    got = matching.until_fatal(items).select("batch_id", "seq")
    assert rows(got) == [("a", 1), ("a", 2), ("c", 1)]


@pytest.mark.parametrize("before, admitted", [(0, True), (4, True), (5, False), (6, False)])
def test_quota_edges(spark, before, admitted):
    data = [(i, "u", "free", f"2024-03-0{i + 1} 00:00:00", True) for i in range(before)]
    data += [(50, "u", "free", "2024-03-20 00:00:00", False), (60, "u", "free", "2024-04-01 00:00:00", True),
             (61, "p", "paid", "2024-03-21 00:00:00", True)]
    items = spark.createDataFrame(data, "item_id int, user_id string, tier string, t string, success boolean").withColumn(
        "ts", F.to_timestamp("t"))
    got = {r["item_id"]: r["admitted"] for r in usage.quota_gate(items).collect()}
    assert got[50] is admitted and got[60] and got[61]
    assert all(got[i] for i in range(min(before, 5)))
    assert {r["admitted"] for r in usage.quota_gate(items, enabled=False).collect()} == {True}


def test_quota_over_two_runs_equals_one(spark):
    data = [(i, "u" if i % 3 else "w", "free", f"2024-03-{i + 1:02d} 00:00:00", i % 4 != 0) for i in range(24)]
    items = spark.createDataFrame(data, "item_id int, user_id string, tier string, t string, success boolean").withColumn(
        "ts", F.to_timestamp("t"))
    whole = rows(usage.quota_gate(items).where("admitted").select("item_id"))
    early, late = items.where("item_id < 9"), items.where("item_id >= 9")
    first = usage.quota_gate(early).where("admitted")
    used = usage.monthly_usage(first)
    second = usage.quota_gate(late, used_before=used).where("admitted")
    assert rows(first.select("item_id").union(second.select("item_id"))) == whole


SF_DIR = "/root/testdata/sf0.001"
SPREAD = [
    "a4_scan_reports", "c1_tenant_scope", "d3_hard_rejects", "d4_ats_coverage_weighted", "e3_report_with_owner",
    "e4_with_profile", "e6_owned_orders", "e7_delete_profiles", "f11_blocking_skills", "g1_until_fatal",
    "g2_quota_gate", "g3_flag_duplicates", "j5_publish_reports", "p1_ranked_report",
]


@pytest.mark.parametrize("name", SPREAD)
def test_queries_with_every_key_hot(spark, monkeypatch, name):
    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    monkeypatch.setattr(history, "BIG_GROUP_SPAN", 3)
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE[name]) == ""
