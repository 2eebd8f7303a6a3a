"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lumenmatch.catalog import QUERIES, banks
from lumenmatch.session import local_session

HEADLINE = (
    "top_matches", "target_stats", "cohesion", "reference_clusters", "competitor_eval", "match_images", "match_videos", "temporal_strength",
    "stable_segments", "score_distribution", "brand_mentions", "ocr_evidence", "caption_evidence", "brand_verdict", "detect_brands",
    "evaluation", "social_analytics", "prompt_table", "blur_filter", "dedupe_frames",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    started = time.perf_counter()
    banks(spark, sf_dir)
    times["build_banks"] = round(time.perf_counter() - started, 3)
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
