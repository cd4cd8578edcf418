"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loomrecord.plans import QUERIES  # noqa: E402
from loomrecord.session import new_session  # noqa: E402

HEADLINE = [
    "s01_scan_records", "o01_page_forward", "o02_page_backward", "o04_top_page", "f15_text_search", "f24_compose", "errors_per_bucket_and_service",
    "n13_application_log", "a02_category_counts", "a04_time_buckets", "a05_insights", "h01_field_stats", "a07_otel_record_summary",
    "a09_dataset_record_summary", "n10_agent_events", "r02_parent_child", "r04_tool_pair", "n07_transcript", "c09_collections", "k02_scoped_export",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = new_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
