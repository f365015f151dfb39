"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).  Each query runs
once cold and then warm, up to BENCH_RUNS times (default 3) or until BENCH_BUDGET
seconds (default 15) are used; the median warm run counts, the cold one is reported
apart.  Nothing is kept between runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from gleaner.workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "prune_decisions",
    "retrieve_top_k",
    "tfidf_vocabulary",
    "text_sections",
    "text_token_counts",
    "dense_top_k",
    "prune_by_preset",
    "split_documents",
    "split_questions",
    "layered_check",
    "chat_pruned",
    "latency_percentiles",
    "policy_summaries",
    "session_history",
    "session_model_updates",
    "replay_calibrated",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    budget = float(os.environ.get("BENCH_BUDGET", "15"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds, cold, warm = {}, {}, {}
    for name in names:
        taken = []
        while len(taken) < 2 or (len(taken) <= runs and sum(taken[1:]) < budget):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        cold[name] = round(taken[0], 3)
        warm[name] = len(taken) - 1
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "shuffle_partitions": int(cpus),
                "warm_runs": warm,
                "cold": cold,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
