"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of per-query medians, sec),
"unit", "queries": {name: sec}, "sf", ...}. Each query is fully materialised
with the ``noop`` sink; one untimed warm-up run, then the median of
$BENCH_REPEATS timed runs (default 1).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from segmenter.plans.catalog import QUERIES  # noqa: E402
from segmenter.session import build_session  # noqa: E402

HEADLINE = [
    "rfm_segments", "segment_summary", "score_tied", "rfm_dirty", "csv_rfm", "quality_report",
    "knn_filtered", "knn_unfiltered", "prompt_digest",
    "history_page", "history_latest", "recent_count", "mute_fold",
    "doc_chunks", "text_bold", "text_wrap50", "users_upsert", "stream_throttle",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8),
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "8g")})
    names = only or HEADLINE

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("segment_summary")  # warm-up: JVM, code generation, file listing
    results = {}
    for name in names:
        results[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
