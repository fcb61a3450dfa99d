"""Wall seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from tidegraph.core import release, session

HEADLINE = (
    "price_summary", "rolling_mean_std", "frequency_variability", "describe", "squares_ljung_box", "kpss", "bds",
    "mutual_information", "false_neighbours", "volatility_grid", "band_split", "sift", "ensemble_sift",
    "decomposition_quality", "trend_purity", "pca_explained", "hvg_edges", "nvg_edges", "recurrence_edges", "clustering",
    "connected_components", "closeness", "strip_latex",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    from tidegraph.plans.catalog import QUERIES

    QUERIES["load_series"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        took[name] = round(statistics.median(runs), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)  # a stop keeps the figures so far
    release(spark)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_wall", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf.group(1)) if sf else None, "cpus": cpus}))


if __name__ == "__main__":
    main()
