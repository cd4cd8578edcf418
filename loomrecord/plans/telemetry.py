"""Queries over telemetry records derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.operators import otel as O
from loomrecord.operators.records import parse_texts
from loomrecord.plans.registry import query, table
from loomrecord.session import deal_rows
from loomrecord.profiles.telemetry import TELEMETRY


def otel_records(spark, sf):
    """Span envelopes, log envelopes and bare spans, logs or metrics, one per order."""
    o = deal_rows(table(spark, sf, "orders")).withColumns({
        "trace": F.expr("'t' || o_custkey"), "sid": F.expr("'s' || o_orderkey"), "t0": F.expr("'1700000000000000000'"),
        "t1": F.expr("cast(1700000000000000000 + o_orderkey * 1500000 AS string)"), "code": F.expr("if(o_orderstatus = 'F', 2, 1)")})
    span = """named_struct('traceId', trace, 'spanId', sid{0}, 'parentSpanId', if(o_orderkey % 2 = 0, 's' || (o_orderkey - 1), null), 'name', o_orderpriority{1}, 'kind', o_orderkey % 6,
              'startTimeUnixNano', t0, 'endTimeUnixNano', t1, 'status', named_struct('code', code))"""
    log = """named_struct('timeUnixNano', t1, 'severityNumber', if(o_orderstatus = 'F', 17, 9), 'body', named_struct('stringValue', o_orderpriority), 'traceId', trace, 'spanId', sid)"""
    resource = "named_struct('attributes', array(named_struct('key', 'host', 'value', named_struct('stringValue', 'h')), named_struct('key', 'service.name', 'value', named_struct('stringValue', 'svc-' || (o_custkey % 5)))))"
    text = f"""CASE o_orderkey % 5
      WHEN 0 THEN to_json(named_struct('resourceSpans', array(named_struct('resource', {resource}, 'scopeSpans', array(named_struct('spans', array({span.format("", "")}, {span.format(" || 'b'", " || '-b'")})))))))
      WHEN 1 THEN '{{"resourceLogs":[' || to_json(named_struct('resource', {resource}, 'scopeLogs', array(named_struct('logRecords', array({log}))))) || ',{{"scopeLogs":[{{"name":"empty"}}]}}]}}'
      WHEN 2 THEN to_json({span.format("", "")}) WHEN 3 THEN to_json({log})
      ELSE to_json(named_struct('name', o_orderpriority, 'unit', '1', 'gauge', named_struct('dataPoints', array(1, 2, o_orderkey)))) END"""
    return o.select(F.lit("otel").alias("source_id"), F.col("o_orderkey").alias("ordinal"), F.expr(text).alias("text"))


def parsed(spark, sf):
    return parse_texts(otel_records(spark, sf))


OT = """ot AS (SELECT o_orderkey AS ordinal, o_orderkey % 5 AS m, o_orderkey, o_custkey, o_orderpriority AS p, o_orderstatus = 'F' AS bad,
  CASE o_orderkey % 5 WHEN 0 THEN 'spans' WHEN 1 THEN 'logs' WHEN 2 THEN 'spans' WHEN 3 THEN 'logs' ELSE 'metrics' END AS signal FROM orders)"""


@query("e01_otel_signals", f"""WITH {OT} SELECT ordinal, signal, CASE WHEN m < 2 THEN 'svc-' || (o_custkey % 5) END AS service, CASE WHEN signal = 'logs' THEN NULL ELSE p END AS name FROM ot
  UNION ALL SELECT ordinal, signal, 'svc-' || (o_custkey % 5), p || '-b' FROM ot WHERE m = 0""")
def e01(spark, sf):
    rows = O.signals(parsed(spark, sf)).filter(F.col("item").isNotNull())
    return rows.select("ordinal", "signal", "service", J.string_at(F.col("item"), "name").alias("name"))


SUMMARY = f"""{OT}, sm AS (SELECT ordinal, signal, m, p, o_custkey, CASE m WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS resource_groups, CASE m WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS scopes,
  CASE m WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS spans, CASE WHEN m IN (1, 3) THEN 1 ELSE 0 END AS logs, CASE WHEN m = 4 THEN 1 ELSE 0 END AS metrics, CASE WHEN m = 4 THEN 0 ELSE 1 END AS traces,
  CASE WHEN m = 4 THEN 3 ELSE 0 END AS data_points, CASE WHEN bad THEN CASE m WHEN 0 THEN 2 WHEN 4 THEN 0 ELSE 1 END ELSE 0 END AS errors,
  CASE m WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END * (o_orderkey * 1500000 // 1000000) AS duration_ms, CASE WHEN o_orderkey % 6 = 2 THEN CASE m WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END ELSE 0 END AS server_spans,
  CASE WHEN m < 2 THEN 'svc-' || (o_custkey % 5) ELSE '' END AS services, CASE m WHEN 0 THEN p || ',' || p || '-b' WHEN 2 THEN p ELSE '' END AS operations FROM ot)"""


@query("a07_otel_record_summary", f"WITH {SUMMARY} SELECT * EXCLUDE (m, p, o_custkey) FROM sm")
def a07(spark, sf):
    s = O.record_summary(O.signals(parsed(spark, sf)))
    return s.select("ordinal", "signal", "resource_groups", "scopes", "spans", "logs", "metrics", "traces", "data_points", "errors", "duration_ms", "server_spans",
                    F.array_join("services", ",").alias("services"), F.array_join("operations", ",").alias("operations"))


@query("a08_otel_sample_summary", f"""WITH {SUMMARY} SELECT count(*) AS recognized, count(*) FILTER (signal = 'spans') AS spans_records, count(*) FILTER (signal = 'logs') AS logs_records, count(*) FILTER (signal = 'metrics') AS metrics_records,
  sum(spans) AS spans, sum(logs) AS logs, sum(metrics) AS metrics, sum(data_points) AS data_points, sum(errors) AS errors, sum(duration_ms) AS duration_ms, sum(traces) AS traces, count(*) AS records FROM sm""")
def a08(spark, sf):
    recs = parsed(spark, sf)
    return O.sample_summary(O.record_summary(O.signals(recs)), recs.agg(F.count(F.lit(1)).alias("records")))


@query("a08_otel_services", f"WITH {SUMMARY} SELECT 'svc-' || (o_custkey % 5) AS name, count(*) AS records FROM sm WHERE m < 2 GROUP BY 1")
def a08b(spark, sf):
    return O.name_counts(O.record_summary(O.signals(parsed(spark, sf))), "services")


@query("n11_telemetry", f"""WITH {OT} SELECT ordinal, rtrim(signal, 's') AS event_kind, CASE WHEN m IN (0, 2) THEN '1700000000000000000' WHEN m IN (1, 3) THEN CAST(1700000000000000000 + o_orderkey * 1500000 AS VARCHAR) END AS timestamp_raw,
  CASE WHEN m IN (2, 3) THEN 't' || o_custkey END AS session_id, CASE WHEN m IN (2, 3) THEN 's' || o_orderkey END AS turn_id, CASE WHEN m = 2 THEN 's' || o_orderkey END AS message_id,
  CASE WHEN m = 3 THEN 's' || o_orderkey WHEN m = 2 AND o_orderkey % 2 = 0 THEN 's' || (o_orderkey - 1) END AS parent_id, CASE WHEN m IN (0, 2) THEN CASE WHEN bad THEN '2' ELSE '1' END END AS status,
  CASE WHEN m IN (0, 2) AND bad THEN 'error' WHEN m IN (1, 3) THEN CASE WHEN bad THEN '17' ELSE '9' END END AS severity,
  CASE m WHEN 0 THEN 'OTLP spans envelope: 1 resource group' WHEN 1 THEN 'OTLP logs envelope: 2 resource groups' WHEN 2 THEN 'Span: ' || p WHEN 3 THEN 'Log: ' || p ELSE 'Metric: ' || p END AS summary FROM ot""")
def n11(spark, sf):
    return TELEMETRY.project(parsed(spark, sf)).select("ordinal", "event_kind", "timestamp_raw", "session_id", "turn_id", "message_id", "parent_id", "status", "severity", "summary")


@query("j17_any_value", "SELECT o_orderkey AS ordinal, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN '[' || o_custkey || ', x, true, 1.5, ...]' WHEN 2 THEN '{a=' || o_custkey || ', b=[y]}' ELSE CAST(o_custkey AS VARCHAR) END AS body FROM orders")
def j17(spark, sf):
    v = F.expr("""parse_json(CASE o_orderkey % 4 WHEN 0 THEN to_json(struct(o_orderpriority AS stringValue))
      WHEN 1 THEN '{"arrayValue":{"values":[{"intValue":"' || o_custkey || '"},{"stringValue":"x"},{"boolValue":true},{"doubleValue":1.5},{"stringValue":"cut"}]}}'
      WHEN 2 THEN '{"kvlistValue":{"values":[{"key":"a","value":{"intValue":' || o_custkey || '}},{"key":"b","value":{"arrayValue":{"values":[{"stringValue":"y"}]}}}]}}' ELSE cast(o_custkey AS string) END)""")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), O.any_value(v).alias("body"))


@query("j18_service", f"WITH {OT} SELECT ordinal, 'svc-' || (o_custkey % 5) AS service FROM ot WHERE m = 0")
def j18(spark, sf):
    recs = parsed(spark, sf)
    return recs.select("ordinal", O.service_of(J.get(F.col("value"), "resourceSpans", 0, "resource")).alias("service")).filter(F.col("service").isNotNull())


@query("j19_error_tests", "SELECT o_orderkey AS ordinal, o_orderstatus = 'F' AS severity_error, o_orderstatus = 'F' AS status_error FROM orders")
def j19(spark, sf):
    sev = F.expr("CASE WHEN o_orderstatus = 'F' THEN if(o_orderkey % 2 = 0, 'FATAL2', '18') ELSE if(o_orderkey % 2 = 0, 'warn', '9') END")
    st = F.expr("CASE WHEN o_orderstatus = 'F' THEN if(o_orderkey % 2 = 0, 'STATUS_CODE_ERROR', '2: late') ELSE if(o_orderkey % 2 = 0, 'ok', '20') END")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), O.severity_is_error(sev).alias("severity_error"), O.status_is_error(st).alias("status_error"))
