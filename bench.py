"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quorumlens.plans import all_queries

HEADLINE = [
    "soft_label_bulk_L1", "item_uncertainty_bulk_L4", "agreement_bulk_L7", "agreement_rollup_L9", "region_projection_P1",
    "conditioned_vectors_P4", "next_event_W1", "typed_pairs_W4", "first_by_content_W9", "soft_counts_T1", "conditionals_T3",
    "graph_prior_T10", "ridge_operators_R1_R4", "centroid_classifier_C1", "product_of_experts_C5", "metric_block_M6_M7_M14",
    "spearman_M12", "tokens_X7", "repetition_X11", "distinct_n_E6", "bleu_E1_E2", "rouge_l_E4", "per_example_E10", "best_of_n_K2",
    "align_K10", "stratified_A3", "cluster_bootstrap_J3", "sample_agreement_J12", "over_seeds_B1", "tfidf_G1", "confusion_similarity_G4",
    "nearest_examples_G15", "communities_G11", "spectral_G12", "spanning_trees_G14", "ridge_vectors_R1_R4", "self_bleu_E7", "ridge_classifier_C2",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries, times = all_queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in HEADLINE:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
