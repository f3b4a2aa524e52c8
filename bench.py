"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import registered  # noqa: E402
from seriesloom.session import build_session  # noqa: E402

HEADLINE = [
    "column_profile", "describe_numeric", "outlier_counts", "value_counts", "dedupe_rows", "corr_matrix", "eta_squared",
    "with_row_index", "series_metrics", "seasonality_strength", "rolling_features", "supervised_matrix", "walk_forward_folds",
    "ffill_bfill", "train_ar", "forecast", "detect_time_axis", "forecastability_series", "prepare_frame", "label_encode",
    "rank_tfidf", "hash_embedding", "vector_topk", "search_catalog", "kpi_rollup", "full_profile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "seriesloom-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    registered.load_all()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        registered.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
