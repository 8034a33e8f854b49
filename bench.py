"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

from netseq.operators import order
from netseq.plans import catalog
from netseq.session import local_session

HEADLINE = [
    "metrics",
    "row_index",
    "split_random",
    "fit_numeric",
    "log_minmax",
    "fit_topk",
    "preprocess",
    "windows_ordered",
    "featurewise",
    "batch_random",
    "batch_sequential",
    "batch_windows",
    "embed_record",
    "pool_avg_all",
    "score_linear",
    "score_encoder",
    "score_decoder",
    "train_classifier",
    "epoch_metrics",
    "early_stop",
    "elapsed",
    "temporal_bias",
    "transfer_matrix",
    "drift_report",
    "experiment_grid",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "netseq-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's and Python's workers before the clock
    for warm in ("metrics", "score_mlp"):
        catalog.QUERIES[warm](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        order._indexed.clear()  # every query pays for its own index
        begin = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, whole tables, every result row computed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
