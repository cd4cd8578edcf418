"""Telemetry records as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.operators import otel as O
from loomrecord.profiles.base import Profile, derived, located_path


# The fields an item shows.
_KEYS = ["name", "traceId", "spanId", "parentSpanId", "startTimeUnixNano", "timeUnixNano", "observedTimeUnixNano", "severityText", "severityNumber", "eventName", "status", "body"]
_CAPITALS = ["Name", "TraceId", "SpanId", "ParentSpanId", "StartTime", "Timestamp", "ObservedTimestamp", "SeverityText", "SeverityNumber", "EventName", "Status", "Body"]


def _prepare(records: DataFrame) -> DataFrame:
    df = O.with_signal(records)
    # An envelope shows the time, severity and service of its first item.
    first = " ".join(
        f"WHEN '{env}' THEN get(flatten(transform({O.items_sql('value', env)}, g -> flatten(transform(coalesce({O.items_sql('g', sc)}, array()), s -> coalesce({O.items_sql('s', it)}, array()))))), 0)"
        for env, sc, it in O.ENVELOPES.values())
    group = " ".join(f"WHEN '{env}' THEN try_variant_get(value, '$.{env}[0].resource', 'variant')" for env, _, _ in O.ENVELOPES.values())
    own = f"coalesce({J.get_sql('value', 'resource')}, {J.get_sql('value', 'Resource')})"
    df = J.fence(df, _item=F.expr(f"CASE _s.container {first} WHEN 'record' THEN value END"), _resource=F.expr(f"CASE _s.container {group} ELSE {own} END"))
    df = O.with_fields(df, "_item", _KEYS, _CAPITALS)
    status = f"coalesce({O.field('status')}, {O.field('Status')})"
    code = f"nullif(concat_ws(': ', {O.scalar_either(status, 'code', 'Code')}, {O.scalar_either(status, 'message', 'Message')}), '')"
    body = J.bind_sql(f"coalesce({O.field('body')}, {O.field('Body')})", "b", O.any_value_sql("b"))
    span, log = F.coalesce(F.col("_s.signal") == "spans", F.lit(False)), F.col("_s.signal") == "logs"
    def text(*keys: str) -> Column:
        return F.expr(O.first_scalar(*keys))
    # Each text is read where its signal shows it.
    return J.fence(
        df, _name=text("name", "Name"), _trace=text("traceId", "TraceId"), _span=text("spanId", "SpanId"), _parent=F.when(span, text("parentSpanId", "ParentSpanId")),
        _started=F.when(span, text("startTimeUnixNano", "StartTime", "Timestamp")), _logged=F.when(~span, text("timeUnixNano", "Timestamp", "observedTimeUnixNano", "ObservedTimestamp")),
        _severity=F.when(~span, text("severityText", "SeverityText", "severityNumber", "SeverityNumber")), _event=F.when(log, text("eventName", "EventName")),
        _status=F.when(span, F.expr(code)), _body=F.when(log, F.expr(body)), _service=O.service_of(F.col("_resource")))


def _columns() -> dict[str, Column]:
    signal, bare = F.col("_s.signal"), F.col("_s.container") == "record"
    span, log = signal == "spans", signal == "logs"
    groups = F.expr("size(coalesce(" + ", ".join(O.items_sql("value", e) for e, _, _ in O.ENVELOPES.values()) + "))")
    envelope = F.concat(F.lit("OTLP "), signal, F.lit(" envelope: "), groups.cast("string"), F.when(groups == 1, " resource group").otherwise(" resource groups"))
    line = F.when(span, F.concat(F.lit("Span: "), F.col("_name"))).when(
        log, F.concat(F.coalesce(F.concat(F.lit("Log "), F.col("_event")), F.lit("Log")), F.lit(": "), F.coalesce("_body", "_event"))
    ).otherwise(F.concat(F.lit("Metric: "), F.col("_name")))
    return {
        "event_kind": J.lookup({"spans": "span", "logs": "log", "metrics": "metric"}, signal),
        "timestamp_raw": F.when(span, F.col("_started")).when(log | ~bare, F.col("_logged")),
        "actor": F.when(bare, "system"), "session_id": F.when(bare & ~(signal == "metrics"), F.col("_trace")),
        "turn_id": F.when(bare & ~(signal == "metrics"), F.col("_span")), "message_id": F.when(bare & span, F.col("_span")),
        "parent_id": F.when(bare & log, F.col("_span")).when(bare & span, F.col("_parent")), "status": F.when(span, F.col("_status")),
        "severity": F.when(span & O.status_is_error(F.col("_status")), "error").when(~span, F.col("_severity")),
        "summary": J.collapse(F.when(bare, line).when(signal.isNotNull(), envelope).otherwise(F.lit("Unknown OpenTelemetry record"))),
        "confidence": F.when(signal.isNotNull(), "source").otherwise("inferred"),
        "derived": derived(service=F.col("_service").cast("variant"), name=F.when(bare, F.col("_name")).cast("variant"), traceId=F.when(bare, F.col("_trace")).cast("variant"),
                           spanId=F.when(bare, F.col("_span")).cast("variant"), containerKind=F.when(~bare, F.col("_s.container")).cast("variant")),
    }


def _signals() -> dict[str, Column]:
    known = F.col("_s").isNotNull()
    return {"envelopes": known & (F.col("_s.container") != "record"), "records": known & (F.col("_s.container") == "record")}


def _score(s, n):
    score = F.when(s["envelopes"] > 0, F.least(F.lit(0.99), 0.9 + 0.09 * F.least(F.lit(1.0), s["envelopes"] / n))).otherwise(
        F.least(F.lit(0.96), 0.74 * F.least(F.lit(1), s["records"]) + 0.22 * F.least(F.lit(1.0), s["records"] / n)))
    return score, (s["envelopes"] > 0) | (s["records"] > 0)


def _evidence() -> dict[str, Column]:
    """Paths of a bare record's ids; envelopes hold many records and prove none."""
    at = lambda *keys: F.when(F.col("_s.container") == "record", located_path("value", *[(k,) for k in keys]))
    log = F.col("_s.signal") == "logs"
    return {
        "timestamp_raw": F.when(log, at("timeUnixNano", "Timestamp", "observedTimeUnixNano", "ObservedTimestamp")).otherwise(at("startTimeUnixNano", "StartTime", "Timestamp")),
        "session_id": at("traceId", "TraceId"), "turn_id": at("spanId", "SpanId"), "message_id": at("spanId", "SpanId"),
        "parent_id": F.when(log, at("spanId", "SpanId")).otherwise(at("parentSpanId", "ParentSpanId")),
    }


TELEMETRY = Profile("opentelemetry", "1", _columns, _signals, _score, _prepare, _evidence, screen=O.with_signal)
