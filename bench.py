"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then three times; the median counts. Cached data is cleared
before every run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from clientele.plans.registry import all_queries  # noqa: E402
from clientele.session import build_session, scratch  # noqa: E402

HEADLINE = (
    "rfm_segment", "segment_profile", "rfm_lines", "descriptive_cltv", "tenure", "churn_label",
    "lifetime_summary", "bgnbd_fit", "gg_fit", "clv", "backtest", "check_df", "describe",
    "outlier_limits", "remove_outliers", "rank_first", "qcut_labels", "city_join", "corr_pairs",
    "value_counts", "sample_exact", "class_metrics", "mann_whitney", "group_sum_topk",
    "csv_roundtrip", "kmeans_segments", "knn_vote", "shapiro",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    names = [n for n in sys.argv[1:] or HEADLINE]
    took: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            spark.catalog.clearCache()
            start = time.perf_counter()
            with scratch(spark):
                registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
