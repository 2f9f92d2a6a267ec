"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the median of three runs each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

import registry
from ebbtide.params import ForestParams, Settings
from ebbtide.plans import training
from ebbtide.session import local_session

HEADLINES = [
    "sales_star_join", "definition_eval", "client_gaps", "feature_history", "feature_windows", "feature_table",
    "churn_label", "stratified_split", "oversample", "kfold", "null_report", "feature_histogram",
    "feature_correlation", "monthly_client", "roc_curve", "auc", "threshold_sweep", "score_features",
    "expected_loss_total", "kpi_summary",
]

#: The fits that are timed, the same in all rounds; the registered ones are larger.
TIMED = Settings(study=registry.SPARSE, forests=(ForestParams(4, 20, max_depth=6, max_bins=64),
                                                 ForestParams(6, 20, max_depth=6, max_bins=64)))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINES
    times = {}
    for name in names:
        measured = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            measured.append(time.perf_counter() - start)
        times[name] = round(statistics.median(measured[1:]), 3)
        print(name, times[name], [round(m, 2) for m in measured], file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        data = registry.stage("data", spark, folder)
        inputs = registry.stage("vectors", spark, folder)
        for name, fit in (
            ("fit_tree", lambda: training.grow_tree(data, inputs, TIMED)),
            ("fit_forest", lambda: training.train_forest(data, inputs, TIMED)),
        ):
            fit()
            start = time.perf_counter()
            fit()
            times[name] = round(time.perf_counter() - start, 3)
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
