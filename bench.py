"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from sessionloom.plans import stages
from sessionloom.plans.queries import QUERIES
from sessionloom.session import local_session

HEADLINE = [
    "normalize_entries", "steering_clusters", "token_estimate", "tokenize_stats", "term_frequency",
    "document_frequency", "tfidf_top_term", "adjacent_cosine", "redact_documents", "session_gaps",
    "segment_ids", "segment_ids_global", "segment_summary", "time_ordered_union", "merge_model_failures",
    "merge_prompts", "finding_patterns", "pattern_clusters", "merged_patterns", "candidate_tools",
    "registry_matches", "trend_metrics", "trend_backfill", "failure_streaks", "route_health",
    "idempotency_keys", "pilot_weekly", "ingestion_rollup", "parsed_responses", "excerpt_batches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["steering_clusters"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        stages.forget()  # every query pays for its own intermediate tables
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
