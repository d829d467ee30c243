"""Time the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS; names as arguments or ``all`` to choose others."""

from __future__ import annotations

import json
import os
import sys
import time
import warnings

warnings.filterwarnings("ignore")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakegauge.catalog import all_queries  # noqa: E402
from lakegauge.session import get_session  # noqa: E402

HEADLINE = [
    "feature_drift",
    "psi_numeric",
    "ks_statistic",
    "psi_categorical",
    "chi_square",
    "suite_from_rules",
    "profile_reference_suite",
    "column_snapshot",
    "top_values",
    "deduplicate_keep_first",
    "fit_and_transform",
    "encode_frequency",
    "encode_target_cross_fit",
    "binary_precision_recall_f1",
    "roc_auc_binary",
    "slice_metrics",
    "calibration_error",
    "threshold_tuning",
    "bootstrap_f1",
    "match_feedback",
    "rolling_window_metrics",
    "error_rate_windows",
    "latency_p99_windows",
    "rate_limit_replay",
    "train_validation_split",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = get_session("bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(queries)
    queries["accuracy"](spark, folder).collect()  # start-up is not part of any query
    took: dict[str, float] = {}
    for name in names:
        start = time.time()
        rows = queries[name](spark, folder).collect()
        took[name] = round(time.time() - start, 3)
        print(f"{name}: {took[name]}s, {len(rows)} rows", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
