"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from tallycell.plans import registry
from tallycell.session import local_session

HEADLINE = ["qc_cell_metrics", "qc_sample_stats", "qc_preview_by_sample", "de_pseudobulk_counts", "markers_rank_sum",
            "norm_log_normalize", "norm_hvg_mean_bins", "graph_knn", "enrich_over_representation", "score_modules"]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    built, times = registry.queries(), {}
    n_lines = spark.read.parquet(f"{root}/lineitem.parquet").count()
    for name in HEADLINE:
        seen = []
        for _ in range(runs):
            spark.catalog.clearCache()
            start = time.perf_counter()
            built[name](spark, root).write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seen), 3)
    print(json.dumps({"metric": "headline queries, wall time, median of runs", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "input_rows_per_sec": {k: round(n_lines / v) for k, v in times.items() if k != "graph_knn"},
                      "sf": root.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
