"""Work per record and rows per task do not depend on the size or the layout of the input."""

import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.operators import lineage as L
from loomrecord.operators import schema as S
from loomrecord.operators.records import parse_texts
from loomrecord.profiles.telemetry import TELEMETRY
from loomrecord.session import ROWS_PER_TASK, deal_rows


def texts(spark, rows):
    return parse_texts(spark.createDataFrame([("s", o, t) for o, t in rows], "source_id string, ordinal bigint, text string"))


def explained(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_paths_parse_a_record_once(spark):
    recs = texts(spark, [(0, '{"a":[1,{"b":[]},null,4],"c d":{"":"x","e":{}},"n":null}'), (1, "[[7]]"), (2, "oops"), (3, '"t"')])
    flat = S.flatten_paths(recs, depth=3, array_entries=3)
    plan = explained(flat)
    assert "Union" not in plan and plan.count("try_parse_json") + plan.count("parseJson") == 1
    got = sorted((r.ordinal, r.display, r.depth, r.kind) for r in flat.select("ordinal", "display", "depth", J.kind(F.col("node")).alias("kind")).collect())
    assert got == sorted([
        (0, "$", 0, "object"), (0, "$.a", 1, "array"), (0, "$.a[0]", 2, "integer"), (0, "$.a[1]", 2, "object"), (0, "$.a[1].b", 3, "array"), (0, "$.a[2]", 2, "null"),
        (0, '$["c d"]', 1, "object"), (0, '$["c d"][""]', 2, "string"), (0, '$["c d"].e', 2, "object"), (0, "$.n", 1, "null"),
        (1, "$", 0, "array"), (1, "$[0]", 1, "array"), (1, "$[0][0]", 2, "integer"), (3, "$", 0, "string")])


def test_examples_are_the_first_distinct_previews(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(400), rng.choice(["few", "many"]), rng.randrange(3), rng.randrange(900)) for _ in range(900)]
    for unplaced in (False, True):
        rows = rows + [(None, "many", 0, 901)] if unplaced else rows
        stats = S.field_stats(texts(spark, [(o, f'{{"{k}":"{few if k == "few" else many}"}}') for o, k, few, many in rows]))
        got = {r.display: (r.seen, r.missing, r.examples) for r in stats.filter("display <> '$'").collect()}
        for name in ("few", "many"):
            first = {}
            for o, k, few, many in rows:
                if k == name:
                    v = str(few if k == "few" else many)
                    old = first.get(v, o)
                    first[v] = o if old is None else old if o is None else min(old, o)
            best = sorted(first, key=lambda v: (first[v] is not None, first[v] or 0, v))[:3]
            seen = sum(k == name for _, k, _, _ in rows)
            assert got[f"$.{name}"] == (seen, len(rows) - seen, best)


def test_high_cardinality_previews_are_not_shuffled(spark):
    """Of a path with a value per record only the first records are grouped by value."""
    recs = texts(spark, [(o, f'{{"id":"v{o}"}}') for o in range(2000)])
    plan = explained(S.field_stats(recs))
    assert "_until" in plan


def test_a_large_row_group_is_dealt_to_several_tasks(spark, tmp_path):
    rows = 2 * ROWS_PER_TASK + 1
    spark.range(rows).coalesce(1).write.parquet(str(tmp_path / "t"))
    dealt = deal_rows(spark.read.parquet(str(tmp_path / "t")))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == rows and max(sizes) <= ROWS_PER_TASK


def test_lineage_keys_do_not_go_back_to_the_records(spark):
    """The test for repeated places reads written ids; the records are parsed once, before."""
    span = '{"traceId":"t1","spanId":"s%d","parentSpanId":"s%d","name":"n","startTimeUnixNano":"1","endTimeUnixNano":"2"}'
    events = TELEMETRY.project(texts(spark, [(1, span % (1, 0)), (2, span % (2, 1)), (2, span % (2, 1)), (3, span % (3, 1))]), evidence=True)
    keys = L.lineage_keys(events)
    plan = explained(keys)
    assert "try_parse_json" not in plan and "parseJson" not in plan
    assert sorted((r.ordinal, r.repeated, r.own_id, r.parent_id) for r in keys.collect()) == sorted(
        [(1, False, "s1", "s0"), (2, True, None, None), (2, True, None, None), (3, False, "s3", "s1")])
