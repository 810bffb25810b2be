"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from paroxys.catalog import QUERIES
from paroxys.session import local_session

HEADLINE = (
    "sliding_windows",
    "sliding_windows_chunked",
    "zscore",
    "downsample",
    "trend_seasonal",
    "iir_filter",
    "siena_intervals",
    "label_detection",
    "label_multi_sop",
    "class_balance",
    "segment_metrics",
    "auc_roc",
    "threshold_sweep",
    "threshold_sweep_voted",
    "full_evaluation",
    "loss_metrics",
    "ensemble_quantile",
    "majority_vote",
    "ema",
    "collar_merge",
    "vote_then_merge",
    "alarm_runs",
    "event_metrics",
    "dwt_bands",
    "feature_vector",
    "dwt_filter",
    "psd",
    "channel_correlation",
    "stratified_split",
    "weighted_sample",
    "knn",
    "knn_loso",
    "prepare_dataset",
    "stream_ema",
    "stream_windows",
    "stream_vote",
    "gbt_first_tree",
    "conformance",
    "merged_dataset",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
