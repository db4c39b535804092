"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR selects the tables, BENCH_CPUS the local cores. Each query runs
once to warm up the JVM and once timed; results go to the no-op sink, so every
column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from pressline import catalog
from pressline.session import local_session

HEADLINE = [
    "turnover_candidates",
    "match_summary",
    "possession_quantity",
    "gap_stats",
    "episode_window",
    "event_context",
    "lookback_state",
    "node_table",
    "knn_edges",
    "episode_audit",
    "pressure_features",
    "cue_screening",
    "graph_propagation",
    "model_manifest",
    "gate_readiness",
    "spaced_sample",
    "threshold_f1",
    "match_metrics",
    "label_finalize",
    "feature_profile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = int(cpus) if cpus.isdigit() else 8
    spark = local_session(cpus, partitions, "pressline-bench")
    queries = catalog.queries()
    times = {}
    for key in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[key] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
