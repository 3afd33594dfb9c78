"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, to time something else
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loomline.queries.catalogue import QUERIES  # noqa: E402
from loomline.session import local_session  # noqa: E402

HEADLINE = [
    "order_ratios",
    "clean_application",
    "application_features",
    "partition_stats",
    "part_payment_rejoin",
    "segment_rollup",
    "first_last_ordered",
    "lookback_orders",
    "lookback_lineitem",
    "bureau_loan_features",
    "bureau_rollup",
    "previous_lookback",
    "pos_lookback",
    "instalment_lookback",
    "card_lookback",
    "feature_matrix",
    "feature_matrix_full",
    "percentile_grid",
    "box_summary",
    "histogram",
    "token_counts",
    "roc_curve",
    "auc",
    "stratified_split",
    "anova_topk",
    "train_lr",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.read.parquet(os.path.join(folder, "orders.parquet")).groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "headline queries, planning and full evaluation",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
