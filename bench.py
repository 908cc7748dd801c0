"""Times the headline queries; prints one JSON line.

Each query runs to the end into Spark's no-op sink. The figure per query is the
median of the timed runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from gradeloom.plans.registry import all_queries

HEADLINES = [
    "validation_by_source",
    "pass_at_k",
    "prompt_accuracy",
    "grpo_advantage",
    "gae_advantage",
    "masked_whiten",
    "policy_loss_stats",
    "batch_metrics",
    "propagate_rewards",
    "tree_fitness",
    "graft_nodes",
    "spearman",
    "assign_batches",
    "balanced_groups",
    "holdout_split",
    "weighted_mixture",
    "cosine_topk",
    "dedup_similar",
    "answers_match",
    "last_boxed",
    "elo_rating",
    "stream_step_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gradeloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gradeloom-bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    by_name = {q.name: q for q in all_queries()}
    wanted = sys.argv[1:] or HEADLINES
    times: dict[str, float] = {}
    for name in wanted:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            by_name[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
