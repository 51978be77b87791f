"""Benchmark the headline workloads.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``: one untimed warm-up, then the median of
``$BENCH_REPEAT`` (default 3) timed runs, each fully executed through the
``noop`` sink (no collection to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_pipeline", "impute_fused_median", "outlier_iqr_cap", "outliers_remove_pct", "scale_standard",
    "scale_robust", "bin_equal_width", "bin_equal_freq", "label_encode", "target_encode", "frequency_encode",
    "aggregation_feature_mean", "dedup_exact_first", "dedup_documents", "text_remove_stopwords",
    "describe", "descriptive_stats", "column_stats", "corr_matrix", "corr_spearman", "corr_cramersv",
    "kbest_f_classif", "frequent_itemsets", "association_rules", "chart_histogram", "chart_boxplot",
    "chart_kde", "chart_words", "chart_acf", "chart_seasonal", "detect_dbscan", "train_test_split",
    "train_logistic", "feature_pipeline", "clean_pipeline", "dedup_fuzzy", "detect_isolation_forest",
    "power_yeojohnson", "train_ridge", "score_saved_ridge", "cluster_kmeans", "cluster_dbscan", "kbest_chi2",
    "chart_kde_hue", "chart_bar_bootstrap", "impute_mice_multi", "csv_inferred",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    from kiln.plans.catalog import REGISTRY
    from kiln.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus))
    times = {}
    for name in names:
        fn = REGISTRY[name]
        fn(spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(repeat):
            t = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf_label = sf.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_label, "cpus": int(cpus), "repeat": repeat}))


if __name__ == "__main__":
    main()
