"""Wall-clock of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all),
BENCH_RUNS (default 1, median is reported), BENCH_QUERIES (comma list, default headline set).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quotelake.plans.registry import all_queries  # noqa: E402
from quotelake.session import build_session  # noqa: E402

HEADLINE = [
    "rank_top3_quotes", "rank_all_in_product_group", "partner_match_top10", "partner_enrich", "amount_validation",
    "quote_issues", "cost_breakdown", "compare_highlights", "extract_warranty", "extract_delivery", "split_multi_option",
    "project_latest_state", "file_dedupe", "compare_table", "rank_score_consistency",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(max(8, int(cpus) * 2)), "spark.driver.memory": "16g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.time() - start
        print(f"{name} {took:.1f}", file=sys.stderr, flush=True)
        return took

    run(names[0])  # warm up the session
    seconds = {name: round(statistics.median(run(name) for _ in range(runs)), 3) for name in names}
    match = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(match.group(1)) if match else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
