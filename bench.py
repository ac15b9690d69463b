"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import sys
import time

HEADLINE = [
    "paired_comparison", "a24_scenario_matrix", "c16_robustness_matrix", "t02_bootstrap_collapsed", "t05_gap_difference",
    "c12_score_responses", "c13_reparse", "f05_numeric_equal", "a04_describe", "a20_best_threshold", "a21_roc_auc",
    "a22_five_numbers", "t09_signed_rank", "t12_kruskal", "t14_category_comparison", "w01_latest_per_key", "w06_group_reservoir",
    "w10_stratified_pick", "w12_greedy_coverage", "p14_exclusion_reasons", "c01_trace_ingestion", "c02_group_sample",
    "c04_materialized_drafts", "c07_review_gate", "c08_merge_gates", "c10_matched_build", "c11_cross_dataset_pairs",
    "c15_model_summary", "c17_discrimination_gaps", "c19_pilot_pairs", "s04_bounded_prefix", "s05_strict_json", "j12_split_leakage",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from evalspark.bindings import QUERIES
    from evalspark.session import build_session
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 16g --conf spark.ui.enabled=false pyspark-shell")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["paired_comparison"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not measured
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
