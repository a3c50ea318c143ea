"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the tables       (default /root/testdata/sf0.1)
BENCH_CPUS     local cores                (default 8)
BENCH_QUERIES  comma list of query names  (default: HEADLINE)
"""

from __future__ import annotations

import json
import os
import re
import time

from jobsift.plans.queries import QUERIES
from jobsift.session import build_session

HEADLINE = (
    "p1_ranked_report", "p1_screen_batches", "p2_history_page", "p3_report_page",
    "b5_extract_job_links", "b6_extract_posting_ids", "b7_validate_text", "b8_word_count",
    "d3_hard_rejects", "d4_ats_coverage", "d4_ats_coverage_weighted", "d18_assemble_results",
    "e2_track", "e4_with_profile", "e7_delete_profiles",
    "f1_batch_rollup", "f2_verdict_counts", "f4_history_tallies", "f5_skill_demand",
    "f11_blocking_skills", "f14_batch_intelligence",
    "g1_until_fatal", "g2_quota_gate", "g3_flag_duplicates", "g4_recent_history",
    "h1_rank_results", "j1_profile_patch", "j2_payment_events", "j3_tracker_updates",
    "j5_publish_reports", "k1_stream_screen", "k3_stream_usage", "l1_score_with",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    # One small run first, so that starting the engine is not booked on a query.
    QUERIES["p1_ranked_report"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(found.group(1)) if found else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
