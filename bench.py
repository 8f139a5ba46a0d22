"""Time the headline queries: prints one JSON line.

$BENCH_SF_DIR is the data (default /root/testdata/sf0.1), $BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from larkspur.plans.queries import QUERIES  # noqa: E402
from larkspur.session import build_session  # noqa: E402

HEADLINES = [
    "profile_lineitem", "profile_nulls", "profile_documents", "profile_by_group", "sample_values", "value_counts",
    "quartiles", "medians", "outlier_report", "bar_top_k", "histogram_price", "histogram_discount",
    "correlation_heatmap", "scatter_sample", "line_daily", "pie_share", "auto_charts", "drilldown", "query_dataset",
    "similar_vectors", "fill_mean", "fill_median", "drop_missing", "remove_outliers_iqr", "one_hot", "label_encode",
    "normalize_z", "cleaning_chain", "infer_types_csv", "read_tsv", "read_json", "read_excel", "ingest_catalog",
    "watch_landing", "primary_workspace", "session_messages", "split_counts", "macro_f1", "r2", "leaderboard_rank",
    "auto_train_clf", "auto_train_reg", "score_saved_model",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINES
    spark = build_session(
        "larkspur-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start the executors
    times = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
