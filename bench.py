"""Bench: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS]; prints ONE JSON line.

Each query is run to completion with a no-op sink (all rows computed, none
collected). The shared preparation (flows table, fitted transforms, drift
reference) is built once and timed as its own entry, as a pipeline would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "write_splits",
    "stratified_split",
    "target_correlation",
    "pairwise_correlation",
    "fit_transform_pipeline",
    "transform_inference",
    "profile_stats",
    "out_of_range_score",
    "rolling_drift",
    "rolling_drift_keyed",
    "drift_status",
    "per_class_report",
    "auc_exact",
    "roc_points",
    "error_rate_window",
    "latency_p95_window",
    "alert_cooldown",
    "apply_labels",
    "request_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("FLOWGUARD_MASTER", f"local[{cpus}]")
    from flowguard.plans import catalog
    from flowguard.plans import drift_queries as dq
    from flowguard.session import build_session

    spark = build_session(master=f"local[{cpus}]", partitions=max(8, int(cpus)))
    qs = catalog.all_queries()
    times: dict[str, float] = {}

    t0 = time.time()
    dq.reference(spark, sf_dir)  # flows table + preparation fit + drift reference
    times["prepare_shared"] = round(time.time() - t0, 3)

    for name in HEADLINE:
        t = time.time()
        qs[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)

    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
