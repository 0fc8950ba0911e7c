"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Each query runs once to warm up; the median of BENCH_RUNS (default 3) counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from parcela.catalog.queries import QUERIES
from parcela.session import local_session

HEADLINE = [
    "price_by_group", "market_stats", "dedup_latest", "duplicate_members", "group_limits_lineitem", "group_limits_by_cells",
    "cap_prices", "cap_numeric_fields", "capping_report_fields", "clean_job", "numeric_profile_lineitem", "compare_models",
    "training_rows", "flatten_listings", "normalize_texts", "listing_ids", "vector_topk", "vector_topk_batch",
    "scrape_signature", "embed_text", "insert_if_absent", "stream_ingest", "vector_topk_lsh", "train_elastic_net", "target_scores", "indexed_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "parcela-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
