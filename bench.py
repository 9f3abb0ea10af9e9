"""Headline timings: heavy jobs computed afresh, and look-ups on stored marts.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] and prints one
JSON line. Conformed tables and input marts are stored first (not timed), as they are
in a batch lakehouse; each job then runs once to warm up and is timed afterwards.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

JOBS = (
    "tumour_vs_reference_contrast", "batch_effect_sensitivity", "reference_triangulation", "mann_whitney_native", "paired_wilcoxon",
    "mutation_frequency_by_gene", "mutation_functional_evidence", "pathway_enrichment", "bootstrap_stability", "graph_node_metrics", "cohort_summary",
)
LOOKUPS = (
    "top_mutated_genes", "consensus_lookup", "pathways_by_cancer", "edge_type_counts", "tumour_vs_normal_lookup", "mutation_class_breakdown",
)


def run(query, spark, sf_dir):
    started = time.perf_counter()
    query(spark, sf_dir).collect()
    return time.perf_counter() - started


def main() -> None:
    from pyspark.sql import SparkSession

    from contrastry.plans.catalog import QUERIES
    from contrastry.session import DEFAULTS

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for key, value in {
        **DEFAULTS, "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in JOBS:
        run(QUERIES[name], spark, sf_dir)
        seconds[name] = round(run(QUERIES[name], spark, sf_dir), 3)
    for name in LOOKUPS:
        for _ in range(2):
            run(QUERIES[name], spark, sf_dir)
        seconds[name] = round(statistics.median(run(QUERIES[name], spark, sf_dir) for _ in range(5)), 3)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
