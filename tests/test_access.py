"""The eight access checks, on rows of two users, and the column constraints."""

import pytest
from pyspark.sql import functions as F

from jobsift.operators import access, changes


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(
        [("r1", "user-a", "DECENT"), ("r2", "user-b", "WEAK")], "id string, user_id string, verdict string")


@pytest.fixture(scope="module")
def tracker(spark):
    return spark.createDataFrame(
        [("t1", "user-a", "Applied", None, "2024-01-01")],
        "id string, user_id string, status string, notes string, updated_at string"
    ).withColumn("updated_at", F.to_timestamp("updated_at"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_other_user_cannot_select(results):
    assert ids(access.rows_of(results, "user-b")) == ["r2"]


def test_other_user_cannot_update_and_row_is_intact(spark, tracker):
    update = spark.createDataFrame(
        [(1, "t1", "user-b", "Offer", None, False, "2024-02-01")],
        "update_id int, id string, user_id string, status string, notes string, has_notes boolean, ts string"
    ).withColumn("ts", F.to_timestamp("ts"))
    new, refused = changes.apply_tracker_updates(tracker, update)
    assert [r["status"] for r in new.collect()] == ["Applied"] and refused.count() == 0


def test_other_user_cannot_delete(spark, tracker):
    asked = spark.createDataFrame([("t1", "user-b")], "id string, user_id string")
    assert ids(changes.apply_tracker_deletes(tracker, asked)) == ["t1"]
    own = spark.createDataFrame([("t1", "user-a")], "id string, user_id string")
    assert ids(changes.apply_tracker_deletes(tracker, own)) == []


def test_own_profile_is_readable(spark):
    profiles = spark.createDataFrame([("user-a",), ("user-b",)], "id string")
    assert ids(access.rows_of(profiles, "user-a", owner="id")) == ["user-a"]


def test_insert_check(results):
    assert ids(access.check_insert(results, "user-a")) == ["r2"]
    assert ids(access.check_insert(results, None)) == ["r1", "r2"]


def test_owner_can_publish_and_anyone_can_read(spark, results):
    stored = results.withColumn("batch_id", F.lit("b"))
    asked = spark.createDataFrame([("q1", "user-a", "b"), ("q2", "user-c", "b")], "request_id string, user_id string, batch_id string")
    now = F.to_timestamp(F.lit("2024-01-01"))
    headers, frozen, refused = changes.publish_reports(stored, asked, now, "secret")
    assert ids(headers) == ["q1"] and ids(frozen) == ["r1"]
    assert [r["request_id"] for r in refused.collect()] == ["q2"]
    slugs = headers.select("slug")
    assert changes.live_reports(headers, F.to_timestamp(F.lit("2024-01-30")), slugs).count() == 1
    # Strictly later: a report is gone at its expiry.
    assert changes.live_reports(headers, F.to_timestamp(F.lit("2024-01-31")), slugs).count() == 0


def test_anonymous_sees_no_results(spark, results):
    assert ids(access.rows_of(results, None)) == []
    nobody = spark.createDataFrame([(None,)], "user_id string")
    assert ids(access.tenant_scope(results, nobody)) == []


def test_constraints(spark):
    rows = spark.createDataFrame(
        [("1", "e", "paid", "openai", 0), ("2", None, "pro", "openai", 0), ("3", "e", None, None, None)],
        "id string, email string, tier string, api_provider string, screens_used_this_month int"
    ).withColumn("created_at", F.lit(1)).withColumn("updated_at", F.lit(1))
    got = {r["id"]: r["problems"] for r in access.constraint_violations(rows, access.PROFILE_RULES).collect()}
    assert got == {"2": ["email is missing", "tier is not allowed: pro"], "3": ["screens_used_this_month is missing"]}
