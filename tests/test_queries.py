"""Registered queries against their check SQL on the smallest tables (a cross-section; tests.oracle runs all)."""

import pytest

from loomrecord.plans import CHECKS, QUERIES
from tests.oracle import compare, duck

SMALL = "/root/testdata/sf0.001"
NAMES = [
    "errors_per_bucket_and_service", "j02_json_kind", "j04_searchable_text", "j12_to_epoch_ms", "f04_ne", "f24_compose", "o02_page_backward", "o05_mixed_order",
    "p01_flatten_paths", "h01_field_stats", "a02_category_counts", "a04_time_buckets", "a05_insights", "a07_otel_record_summary", "a09_dataset_record_summary",
    "a13_call_record_summary", "n07_transcript", "n13_application_log", "r02_parent_child", "r04_tool_pair", "r12_lookup_window", "r14_build_graph", "c09_collections",
    "s02_ordinals", "k02_scoped_export", "t04_spine", "x04_incremental_relations", "x05_stream_buckets",
]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SMALL, QUERIES[name], CHECKS[name])
    assert ok, note


def test_every_query_has_a_check():
    assert set(CHECKS) <= set(QUERIES)


def test_hot_key_uses_blocks(spark):
    """One id on every row: carried values agree with a plain scan at any block size."""
    from pyspark.sql import functions as F

    from loomrecord.operators.relate import carry

    df = spark.range(500).select(F.lit("k").alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 7 == 3, F.col("id")).alias("v"))
    for block in (1, 16, 1000):
        got = carry(df, ["k"], "o", {"last": ("v", True), "next": ("v", False)}, block).collect()
        for r in got:
            before = [x for x in range(r.o + 1) if x % 7 == 3]
            after = [x for x in range(r.o, 500) if x % 7 == 3]
            assert (r["last"], r["next"]) == (before[-1] if before else None, after[0] if after else None)
