"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_QUERIES (comma-separated) other
queries. Every query runs once unmeasured; the median of up to three runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bug_fix_flags",
    "issue_confirmed_commits",
    "text_metrics",
    "page_constructs",
    "commit_detail",
    "first_files",
    "version_pairs",
    "process_metrics_now",
    "process_metrics_at_commits",
    "inducing_commits",
    "tracing_statistics",
    "blame_lines",
    "multiset_line_diff",
    "file_features",
    "function_features",
    "labelled_dataset",
    "stratified_split",
    "anova_scores",
    "mutual_information",
    "nearest_neighbours",
    "roc_auc",
    "confusion_scores",
    "predictions_by_function",
    "fixed_model_scores",
    "stream_daily_changes",
]
LONG_RUN = 4.0


def timed(build, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    from faultline.plans.catalog import QUERIES
    from faultline.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=cpus * 2)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        first = timed(QUERIES[name], spark, sf_dir)
        runs = [timed(QUERIES[name], spark, sf_dir) for _ in range(1 if first > LONG_RUN else 3)]
        seconds[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
