"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
data and the cores; BENCH_QUERIES (comma-separated) narrows the list.
"""

from __future__ import annotations

import json
import os
import time

from mediaspark.queries import registry
from mediaspark.session import local_session

HEADLINE = (
    "word_freq", "retrieval_topk", "top_candidate", "availability_report", "denylist_candidates", "sentence_split",
    "pace_timing", "floor_cascade", "split_long_rows", "word_timings", "caption_lines", "active_line", "render_status",
    "match_report", "exact_dedup", "near_dup_pairs", "near_dup_clusters", "unique_names", "index_plan", "vector_topk",
    "category_merge", "progress_latest", "rate_window", "assign_greedy", "transcript_align", "caption_cues", "score_hits",
    "library_retrieval", "removal_plan", "full_timing",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores, "8g", int(cores) if cores.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = registry.queries()
    times: dict[str, float] = {}
    for name in names:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
