"""Time the headline queries: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and once for the time that counts; a query is timed until all its rows are produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "G01_run_readonly",
    "G05_statement_review",
    "G07_audit_rollup",
    "A01_column_stats",
    "A02_numeric_stats",
    "A05_histogram",
    "A26_char_entropy",
    "R03_exact_containment",
    "R09_cross_table_correlation",
    "N01_split_edges",
    "N06_best_paths",
    "J09_as_of",
    "W01_top_n_per_key",
    "W02_islands",
    "U05_training_set",
    "M02_wide_table",
    "M04_categorical_screening",
    "M05_numeric_screening",
    "M06_stability",
    "M12_apply_scorecard",
    "M14_ranking_metrics",
    "K04_top_share_ties",
    "K05_vector_top_k",
    "N12_similar_nodes",
    "T02_bm25",
    "T06_mention_linking",
    "W06_interval_union",
    "W08_model_turns",
    "X03_multiset_equality",
    "A28_cube_profile",
    "B05_counterfactuals",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from ledgerlens.plans.registry import load_all

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue, times = load_all(), {}
    only = sys.argv[1:]
    for name in [n for n in HEADLINE if not only or n.startswith(tuple(only))]:
        for _ in range(2):
            start = time.perf_counter()
            catalogue[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
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
