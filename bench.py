"""Time the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES choose what runs."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortile.plans.catalog import QUERIES  # noqa: E402
from cohortile.session import build_session, release  # noqa: E402

HEADLINE = [
    "snv_class_pivot", "variants_goi", "vaf_compare", "matrix_build", "zscore", "rank_avg", "group_means_fit",
    "de_table", "de_by_stratum", "bh_adjust", "volcano_combined", "wilcoxon_pairs", "kruskal_by", "box_stats",
    "ssgsea", "gsva", "signature_score", "oneclass_train", "loo_auc", "pca_samples", "sample_distance", "export_gct",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["snv_class_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            release(spark)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
