"""Headline queries at one scale; prints one JSON line.

Every query runs once to warm up and is then timed, into the noop sink, so that all columns and rows are
computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rolescope.plans import QUERIES  # noqa: E402
from rolescope.session import local_session  # noqa: E402

HEADLINE = (
    "tier_counts", "dedup_first_wins", "reject_reasons", "keyword_score", "rule_table_score", "new_vs_catalog",
    "top_scores", "score_compare", "score_merge", "cost_totals", "llm_requests", "bullet_pick", "tailored_text",
    "artifact_paths", "excerpt", "segment_lines", "run_together", "industry_tags", "page_links", "page_text",
    "page_description", "upgrade_upsert", "state_upsert", "cascade_delete", "plans_nested", "plan_report",
    "plan_tiers", "catalog_view", "batch_stats_map", "auto_status", "change_feed", "flow_edges", "csv_import",
)


def run(query, spark, folder):
    query(spark, folder).write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "rolescope-bench", **{"rolescope.partitions": str(cpus)})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        run(QUERIES[name], spark, folder)
        start = time.perf_counter()
        run(QUERIES[name], spark, folder)
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, warm, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
