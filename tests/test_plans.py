"""What the physical plans must and must not contain."""

import pytest

from jobsift.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
STREAMS = {n for n in QUERIES if n.startswith("k")}
WRITES = {"a1_scan_screenings", "a2_scan_profiles", "a3_scan_tracker", "a4_scan_reports", "a7_append_screenings",
          "a8_export_batches_csv", "a8_export_all_csv", "a9_export_ranked_csv"}


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS - WRITES))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert ("MapInPandas" in text) == (name == "l1_score_with")


@pytest.mark.parametrize("name", ["g4_recent_history", "f5_skill_demand", "g2_quota_gate", "b11_cap_batch"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_link_extraction_does_not_shuffle(spark):
    for name in ("b5_extract_job_links", "b6_extract_posting_ids", "b7_validate_text", "b8_word_count"):
        assert "Exchange" not in plan(spark, name)


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(spark, "c3_live_reports")
    assert "text:string" not in text and "html:string" not in text
    assert "EqualTo(event_type,click)" in plan(spark, "j4_tracker_deletes")
