"""Telemetry envelopes: signal rows, per-record summaries and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J

# Envelope, scope and item keys of each signal, in order of precedence.
ENVELOPES = {"spans": ("resourceSpans", "scopeSpans", "spans"), "logs": ("resourceLogs", "scopeLogs", "logRecords"),
             "metrics": ("resourceMetrics", "scopeMetrics", "metrics")}
SPAN_KINDS = {"0": "unspecified", "1": "internal", "2": "server", "3": "client", "4": "producer", "5": "consumer",
              "unspecified": "unspecified", "internal": "internal", "server": "server", "client": "client", "producer": "producer", "consumer": "consumer"}
METRIC_KINDS = ["gauge", "sum", "histogram", "exponentialHistogram", "summary"]


def items_sql(value: str, key: str) -> str:
    return f"try_variant_get({value}, '$.{key}', 'array<variant>')"


def scalar_either(value: str, *keys: str) -> str:
    """First scalar under a lower- or upper-case spelling."""
    return J.coalesce_sql(*[J.scalar_sql(J.get_sql(value, k)) for k in keys])


# The fields that tell a record's signal. Names that begin with a capital stand in a struct of their own.
_ENVELOPE_KEYS = [env for env, _, _ in ENVELOPES.values()]
_SIGNAL_KEYS = [*_ENVELOPE_KEYS, "traceId", "spanId", "name", "startTimeUnixNano", "endTimeUnixNano", "status", "kind", "body", "timeUnixNano", "observedTimeUnixNano",
                "severityText", "severityNumber", *METRIC_KINDS]
_SIGNAL_CAPITALS = ["TraceId", "SpanId", "Name", "StartTime", "EndTime", "Status", "Body", "Timestamp", "ObservedTimestamp", "SeverityText", "SeverityNumber"]


def _capital(key: str) -> str:
    return key[0].upper() + key[1:]


def field(key: str) -> str:
    """A field of the structs made by `with_fields`."""
    return f"{'_u' if key[0].isupper() else '_l'}.{key}"


def with_fields(df: DataFrame, value: str, keys: list[str], capitals: list[str]) -> DataFrame:
    """`_l` and `_u`: the named fields of an object, taken apart once per row."""
    return J.fence(df, _l=J.fields(F.col(value), *keys), _u=J.fields(F.col(value), *capitals))


def first_scalar(*keys: str) -> str:
    """First scalar among fields of the structs made by `with_fields`."""
    return J.coalesce_sql(*[J.scalar_sql(field(k)) for k in keys])


def _evidence_sql(signal: str) -> str:
    env, scope, item = ENVELOPES[signal]
    return f"exists(try_variant_get({field(env)}, '$', 'array<variant>'), g -> exists({items_sql('g', scope)}, s -> size({items_sql('s', item)}) > 0))"


def _has(*keys: str) -> str:
    return "(" + " OR ".join(f"{field(k)} IS NOT NULL" for k in keys) + ")"


def _scalar(*keys: str) -> str:
    return f"({first_scalar(*keys)} IS NOT NULL)"


IS_SPAN = (
    f"(({_scalar('traceId')} AND {_scalar('spanId')} AND {_scalar('name')} AND {_scalar('startTimeUnixNano')} "
    f"AND ({_scalar('endTimeUnixNano')} OR {_has('status', 'kind')})) "
    f"OR ({_scalar('TraceId')} AND {_scalar('SpanId')} AND {_scalar('Name')} AND {_scalar('StartTime')} "
    f"AND ({_scalar('EndTime')} OR {_has('Status')})))"
)
_SEVERITY = _scalar("severityText", "severityNumber", "SeverityText", "SeverityNumber")
IS_LOG = (
    f"({_SEVERITY} AND (({_has('body')} AND {_scalar('timeUnixNano', 'observedTimeUnixNano')}) "
    f"OR ({_has('Body')} AND {_scalar('Timestamp', 'ObservedTimestamp')})))"
)


def metric_case(then) -> str:
    """CASE arms over the metric kinds, without the last: `then` gives the SQL of a kind."""
    return "CASE " + " ".join(f"WHEN {J.is_object_sql(field(k))} OR {J.is_object_sql(field(_capital(k)))} THEN {then(k)}" for k in METRIC_KINDS)


IS_METRIC = f"({_scalar('name', 'Name')} AND {metric_case(lambda k: 'true')} ELSE false END)"


def with_signal(records: DataFrame) -> DataFrame:
    """`_s`: struct(signal, container) of each record: an envelope, a bare span, log or metric, or NULL."""
    env = " ".join(f"WHEN {_evidence_sql(s)} THEN named_struct('signal', '{s}', 'container', '{ENVELOPES[s][0]}')" for s in ENVELOPES)
    bare = " ".join(f"WHEN {test} THEN named_struct('signal', '{s}', 'container', 'record')" for s, test in (("spans", IS_SPAN), ("logs", IS_LOG), ("metrics", IS_METRIC)))
    df = with_fields(records, "value", _SIGNAL_KEYS, [*_SIGNAL_CAPITALS, *map(_capital, METRIC_KINDS)])
    return J.fence(df, _s=F.expr(f"CASE {env} {bare} END")).drop("_l", "_u")


def service_of(resource: Column) -> Column:
    """Service.name of a resource, given directly or as an attribute."""
    found = "get(filter(coalesce(try_variant_get(v, '$.attributes', 'array<variant>'), try_variant_get(v, '$.Attributes', 'array<variant>')), a -> try_variant_get(a, '$.key', 'string') = 'service.name'), 0)"
    direct = scalar_either("v", "service.name", "serviceName")
    attr = J.bind_sql(J.get_sql(found, "value"), "a", any_value_sql("a", 1))
    return F.when(resource.isNotNull(), J.let_sql(resource, f"coalesce({direct}, {attr})"))


def any_value_sql(value: str, depth: int = 2, max_items: int = 4) -> str:
    """Text of a typed telemetry value, lists and maps to the given depth."""
    x, n = f"a{depth}", f"i{depth}"
    whole = f"regexp_replace(try_variant_get({x}, '$', 'string'), '[.]0$', '')"
    scalar = J.coalesce_sql(*[f"if(schema_of_variant({g}) rlike '^(STRING|BOOLEAN|BIGINT|DOUBLE|DECIMAL)', regexp_replace(try_variant_get({g}, '$', 'string'), '[.]0$', ''), null)"
                              for g in (J.get_sql(x, k) for k in ("stringValue", "boolValue", "intValue", "doubleValue", "bytesValue"))])
    out = f"WHEN schema_of_variant({x}) rlike '^(STRING|BOOLEAN|BIGINT|DOUBLE|DECIMAL)' THEN {whole} "
    nested = ""
    if depth > 0:
        arr, kv = f"try_variant_get({x}, '$.arrayValue.values', 'array<variant>')", f"try_variant_get({x}, '$.kvlistValue.values', 'array<variant>')"
        more = f"if(size({{}}) > {max_items}, ', ...', '')"
        inner = any_value_sql(n, depth - 1, max_items)
        entry = any_value_sql(J.get_sql(n, "value"), depth - 1, max_items)
        nested = (
            f", CASE WHEN {arr} IS NOT NULL THEN concat('[', array_join(transform(slice({arr}, 1, {max_items}), {n} -> {inner}), ', '), {more.format(arr)}, ']') "
            f"WHEN {kv} IS NOT NULL THEN concat('{{', array_join(transform(slice({kv}, 1, {max_items}), {n} -> concat(try_variant_get({n}, '$.key', 'string'), '=', {entry})), ', '), {more.format(kv)}, '}}') END"
        )
    return J.bind_sql(value, x, f"CASE {out} ELSE coalesce({scalar}{nested}, try_variant_get({x}, '$', 'string')) END")


def any_value(value: Column) -> Column:
    return J.let_sql(value, any_value_sql("v"))


def severity_is_error(text: Column) -> Column:
    """Error or fatal in the text, or 17 to 24."""
    return F.coalesce(text.rlike("(?i)error|fatal") | text.try_cast("double").between(17, 24), F.lit(False))


def status_is_error(text: Column) -> Column:
    """Error in the text, or code 2."""
    return F.coalesce(text.rlike(r"(?i)error") | text.rlike(r"^2(\b|:)"), F.lit(False))


def signals(records: DataFrame, key: tuple[str, ...] = ("source_id", "ordinal")) -> DataFrame:
    """One row per span, log record or metric, whatever the nesting. One pass, no shuffle."""
    df = with_signal(records).filter(F.col("_s").isNotNull()).select(*key, "value", "_s.*")
    groups = "CASE container " + " ".join(f"WHEN '{env}' THEN {items_sql('value', env)}" for env, _, _ in ENVELOPES.values()) + " ELSE array(value) END"
    df = df.select(*key, "signal", "container", F.posexplode(F.expr(groups)).alias("group_no", "g"))
    # A resource is read once for all items of its group.
    df = J.fence(df, service=service_of(F.coalesce(J.get(F.col("g"), "resource"), J.get(F.col("g"), "Resource"))))
    scopes = "CASE signal " + " ".join(f"WHEN '{s}' THEN {items_sql('g', sc)}" for s, (_, sc, _) in ENVELOPES.items()) + " END"
    df = df.select(*key, "signal", "container", "group_no", "service", F.posexplode_outer(F.expr(f"if(container = 'record', array(g), {scopes})")).alias("scope_no", "sc"))
    items = "CASE signal " + " ".join(f"WHEN '{s}' THEN {items_sql('sc', it)}" for s, (_, _, it) in ENVELOPES.items()) + " END"
    df = df.select(*key, "signal", "container", "group_no", "service", "scope_no", F.posexplode_outer(F.expr(f"if(container = 'record', array(sc), {items})")).alias("item_no", "item"))
    # Groups without items stay as rows with a NULL item, so that group and scope counts are whole.
    return J.fence(df, _object=J.is_object(F.col("item"))).select(
        *key, "signal", "container", "group_no", "scope_no", "item_no", F.when(F.col("_object"), F.col("item")).alias("item"), "service")


def record_summary(rows: DataFrame, key: tuple[str, ...] = ("source_id", "ordinal")) -> DataFrame:
    """Counts per record over its signal rows."""
    span, log, metric = (F.col("signal") == s for s in ENVELOPES)
    there = F.col("item").isNotNull()
    def text(*keys: str) -> Column:
        return F.expr(first_scalar(*keys))
    rows = with_fields(rows, "item", ["name", "traceId", "kind", "status", "startTimeUnixNano", "endTimeUnixNano", "severityText", "severityNumber", *METRIC_KINDS],
                       ["Name", "TraceId", "Kind", "Status", "StartTime", "EndTime", "SeverityText", "SeverityNumber", *map(_capital, METRIC_KINDS)])
    status = F.expr(scalar_either(f"coalesce({field('status')}, {field('Status')})", "code", "Code"))
    points = F.expr(metric_case(lambda k: f"size(coalesce({items_sql(field(k), 'dataPoints')}, array()))") + " ELSE 0 END")
    # Each fact is read where its signal uses it.
    facts = J.fence(
        rows, _name=F.when(span, text("name", "Name")), _trace=F.when(~metric, text("traceId", "TraceId")), _kind=F.when(span, text("kind", "Kind")), _code=F.when(span, status),
        _start=F.when(span, text("startTimeUnixNano", "StartTime")), _end=F.when(span, text("endTimeUnixNano", "EndTime")),
        _severity=F.when(log, text("severityText", "SeverityText", "severityNumber", "SeverityNumber")), _points=F.when(metric, points).cast("bigint"))
    span_error = F.col("_code").rlike("(?i)error|fatal") | (F.col("_code") == "2")
    log_error = F.col("_severity").rlike("(?i)error|fatal") | (F.col("_severity").try_cast("double") >= 17)
    start, end = F.col("_start").try_cast("decimal(38,0)"), F.col("_end").try_cast("decimal(38,0)")
    ms = F.when(end > start, F.floor((end - start) / 1_000_000))
    kind = F.when(F.col("_kind").isNull(), "unspecified").otherwise(F.coalesce(J.lookup(SPAN_KINDS, F.lower("_kind")), F.lit("unknown")))
    counted = facts.select(*key, "signal", "container", "group_no", "scope_no", "service", (span & there).alias("is_span"), (log & there).alias("is_log"),
                           (metric & there).alias("is_metric"), "_name", "_trace", kind.alias("_kind"), ms.cast("bigint").alias("_ms"), "_points",
                           F.coalesce((span & span_error) | (log & log_error), F.lit(False)).alias("_error"))
    n = F.count_if
    return counted.groupBy(*key).agg(
        F.first("signal").alias("signal"), F.first("container").alias("container"),
        (F.when(F.first("container") == "record", 0).otherwise(F.max("group_no") + 1)).cast("bigint").alias("resource_groups"),
        F.size(F.collect_set(F.when((F.col("container") != "record") & F.col("scope_no").isNotNull(), F.struct("group_no", "scope_no")))).cast("bigint").alias("scopes"),
        n("is_span").alias("spans"), n("is_log").alias("logs"), n("is_metric").alias("metrics"),
        F.size(F.collect_set(F.when(~F.col("is_metric"), F.col("_trace")))).cast("bigint").alias("traces"),
        F.sum(F.when(F.col("is_metric"), F.col("_points")).otherwise(0)).cast("bigint").alias("data_points"),
        n("_error").alias("errors"), F.coalesce(F.sum(F.when(F.col("is_span"), F.col("_ms"))), F.lit(0)).cast("bigint").alias("duration_ms"),
        n(F.col("is_span") & (F.col("_kind") == "server")).alias("server_spans"), n(F.col("is_span") & (F.col("_kind") == "client")).alias("client_spans"),
        F.array_sort(F.collect_set("service")).alias("services"), F.array_sort(F.collect_set(F.when(F.col("is_span"), F.col("_name")))).alias("operations"),
    )


def sample_summary(summaries: DataFrame, total: DataFrame) -> DataFrame:
    """Totals over the record summaries and coverage of all records (`total` has one row)."""
    out = summaries.agg(
        F.count(F.lit(1)).alias("recognized"), *[F.count_if(F.col("signal") == s).alias(f"{s}_records") for s in ENVELOPES],
        *[F.sum(c).cast("bigint").alias(c) for c in ("spans", "logs", "metrics", "data_points", "errors", "duration_ms", "traces")])
    return out.join(F.broadcast(total))


def name_counts(summaries: DataFrame, field: str) -> DataFrame:
    """Services or operations by number of records, then by name."""
    return summaries.select(F.explode(field).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("records")).orderBy(F.col("records").desc(), "name")
