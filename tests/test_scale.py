"""Costly steps are done once per row or once per round, with the same results."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from loomrecord.operators import graph as G
from loomrecord.operators import otel as O
from loomrecord.operators import page as P
from loomrecord.operators.records import parse_texts
from loomrecord.plans import QUERIES


def texts(spark, rows):
    return parse_texts(spark.createDataFrame([("s", o, t) for o, t in rows], "source_id string, ordinal bigint, text string"))


def explained(df):
    out, conf = io.StringIO(), df.sparkSession.conf
    conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        with redirect_stdout(out):
            df.explain()
    finally:
        conf.unset("spark.sql.debug.maxToStringFields")
    return out.getvalue()


def test_signals_take_a_record_apart_once(spark):
    """Each field is taken from one struct of the record, and a resource is read once for its group."""
    span = '{"traceId":"t","spanId":"%s","name":"n","Name":"N","startTimeUnixNano":1,"endTimeUnixNano":"2","kind":2,"status":{"code":2}}'
    env = ('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"a"}}]},"scopeSpans":[{"spans":[%s,%s]}]},7,'
           '{"resource":{"serviceName":"b"},"scopeSpans":[{}]}]}' % (span % "1", span % "2"))
    recs = texts(spark, [(0, env), (1, span % "3"), (2, span % ""), (3, '{"TraceId":"t","SpanId":"s","Name":"n","StartTime":1,"Status":null}'),
                         (4, '{"Name":"m","Gauge":{},"gauge":{"dataPoints":[1,2]}}'), (5, '{"severityNumber":9,"body":null,"timeUnixNano":0}'), (6, "null"), (7, "[]"), (8, "x")])
    rows = O.signals(recs)
    assert "StructField(resourceSpans,VariantType" in explained(rows)
    got = {r.ordinal: r for r in O.record_summary(rows).collect()}
    assert {o: (r.signal, r.container, r.spans, r.logs, r.metrics, r.data_points, r.errors, r.server_spans, r.services, r.operations) for o, r in got.items()} == {
        0: ("spans", "resourceSpans", 2, 0, 0, 0, 2, 2, ["a", "b"], ["n"]), 1: ("spans", "record", 1, 0, 0, 0, 1, 1, [], ["n"]),
        3: ("spans", "record", 1, 0, 0, 0, 0, 0, [], ["n"]), 4: ("metrics", "record", 0, 0, 1, 2, 0, 0, [], []), 5: ("logs", "record", 0, 1, 0, 0, 0, 0, [], [])}


def test_mixed_order_works_out_keys_once(spark):
    rows = [(0, '{"m":{"b":1.0,"a":2}}'), (1, '{"m":[1.0,2]}'), (2, '{"m":2}'), (3, '{"m":1.5}'), (4, '{"m":null}'), (5, "{}"), (6, '{"m":"s"}'), (7, '{"m":true}'), (8, '{"m":false}'), (9, '{"m":""}')]
    recs = texts(spark, rows)
    up = P.sort_mixed(recs, ["m"])
    assert up.columns == recs.columns
    assert explained(up).count("get_json_object") == 1
    assert [r.ordinal for r in up.collect()] == [1, 8, 7, 3, 2, 0, 9, 6, 4, 5]
    assert [r.ordinal for r in P.sort_mixed(recs, ["m"], descending=True).collect()] == [6, 9, 0, 2, 3, 7, 8, 1, 4, 5]


def test_a_sorted_column_is_parsed_once(spark, tmp_path, monkeypatch):
    """The sort samples and reads written columns, not the records."""
    spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' AS ts, id % 3 AS user_id, if(id % 2 = 0, 'error', 'view') AS event_type, 1.5D AS value, '{\"k\":1}' AS props FROM range(40)").write.parquet(
        str(tmp_path / "events.parquet"))
    plans, real = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, *a: plans.append(explained(df)) or real(df, *a))
    rows = sorted(QUERIES["o06_sort_column"](spark, str(tmp_path)).collect(), key=lambda r: r.position)
    assert len(plans) == 1 and "parse_json" not in plans[0].lower() and "parsejson" not in plans[0].lower()
    seen = [(r.severity is None, r.severity or "", r.ordinal) for r in rows]
    assert seen == sorted(seen) and [r.position for r in rows] == list(range(1, 41))


def test_only_edges_of_crowded_nodes_are_ranked(spark):
    """Rounds rank the ends of nodes over the limit; equal, null and dangling ids keep their meaning."""
    nodes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1), (None, 1)], "id string, seq bigint")
    edges = spark.createDataFrame(
        [("e1", "a", "b", 1), ("e2", "a", "c", 2), ("e3", "a", "d", 3), ("e4", "a", "a", 4), ("e5", "b", "c", 5), ("e5", "b", "x", 9), ("e6", "x", "b", 6),
         (None, "a", "b", 7), ("e7", None, "b", 8), ("e8", "c", "d", None)], "id string, src string, dst string, seq bigint")
    scan = []
    real = G.materialize
    try:
        G.materialize = lambda df, name="stage", *a: scan.append((name, out := real(df, name, *a))) or out
        _, kept, bad = G.build_graph(nodes, edges, max_degree=2)
        _, loose, none = G.build_graph(nodes, edges, max_degree=9)
    finally:
        G.materialize = real
    first = next(df for name, df in scan if name == "degree")
    assert {r.n for r in first.select("n").distinct().collect()} == {"a"}
    assert sorted((r.id, r.src, r.dst) for r in kept.collect()) == [("e1", "a", "b"), ("e2", "a", "c"), ("e5", "b", "c")]
    assert sorted(r.id for r in bad.filter("code = 'degree-limit'").collect()) == ["e3", "e4"]
    assert sorted(((r.code, r.id or "") for r in bad.filter("code <> 'degree-limit'").collect())) == [
        ("duplicate-edge", ""), ("duplicate-edge", "e5"), ("duplicate-edge", "e8"), ("duplicate-node", ""), ("duplicate-node", "a"), ("missing-endpoint", "e6"), ("missing-endpoint", "e7")]
    assert loose.count() == 5 and none.filter("code = 'degree-limit'").count() == 0
