"""Queries over log records: values, predicates, pages, schema and insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.functions.content import code_language, content_class
from loomrecord.functions.embedded import embedded_json
from loomrecord.functions.features import Feature, semantic_features
from loomrecord.functions import times as T
from loomrecord.operators import insights as A
from loomrecord.operators import page as P
from loomrecord.operators import records as R
from loomrecord.operators.records import parse_texts
from loomrecord.operators import schema as S
from loomrecord.operators import where as W
from loomrecord.plans.corpora import LOGS, log_records
from loomrecord.plans.registry import query, table
from loomrecord.session import materialize, spread
from loomrecord.profiles.logs import APP_LOG, log_level, project_generic, severity_is_error_log, trace_id


def log_events(spark: SparkSession, sf: str) -> DataFrame:
    return APP_LOG.project(log_records(spark, sf))


IS_LOG = "message IS NOT NULL AND severity IS NOT NULL"

# ---- J: values ---------------------------------------------------------------


@query("j01_json_get", f"""WITH {LOGS} SELECT ordinal, k AS props_k, CASE WHEN mixed_kind = 'array' THEN 2 END AS mixed_1,
  ordinal % 4 AS odd, CASE WHEN ordinal % 7 = 5 THEN ordinal % 3 END AS mixed_k, mixed_kind IS NOT NULL AS has_mixed, COALESCE(mixed_kind = 'null', false) AS null_mixed FROM logs""")
def j01(spark, sf):
    v = F.col("value")
    return log_records(spark, sf).select(
        "ordinal", F.try_variant_get(J.get(v, "props", "k"), "$", "bigint").alias("props_k"),
        F.try_variant_get(J.get(v, "mixed", 1), "$", "bigint").alias("mixed_1"), F.try_variant_get(J.get(v, "odd key"), "$", "bigint").alias("odd"),
        F.try_variant_get(J.get(v, "mixed", "k"), "$", "bigint").alias("mixed_k"),
        J.get(v, "mixed").isNotNull().alias("has_mixed"), J.is_json_null(J.get(v, "mixed")).alias("null_mixed"),
    )


@query("j02_json_kind", f"WITH {LOGS} SELECT ordinal, mixed_kind AS kind FROM logs")
def j02(spark, sf):
    return log_records(spark, sf).select("ordinal", J.kind(J.get(F.col("value"), "mixed")).alias("kind"))


# Every path of the log records, with the kind and the text of its value.
PATHS = LOGS + """, n AS (SELECT '$' AS display, ordinal, 'object' AS kind, NULL::VARCHAR AS t FROM logs
  UNION ALL SELECT '$.timestamp', ordinal, CASE WHEN ordinal % 13 = 0 THEN 'integer' ELSE 'string' END, timestamp_raw FROM logs WHERE ordinal % 13 <> 1
  UNION ALL SELECT '$.level', ordinal, CASE WHEN event_type = 'click' THEN 'integer' ELSE 'string' END, CASE WHEN event_type = 'click' THEN '30' ELSE severity END FROM logs WHERE severity IS NOT NULL
  UNION ALL SELECT '$.message', ordinal, 'string', message FROM logs WHERE message IS NOT NULL UNION ALL SELECT '$.service', ordinal, 'string', service FROM logs WHERE service IS NOT NULL
  UNION ALL SELECT '$.logger', ordinal, 'string', logger FROM logs UNION ALL SELECT '$.requestId', ordinal, 'string', request_id FROM logs UNION ALL SELECT '$.type', ordinal, 'string', event_type FROM logs
  UNION ALL SELECT '$.traceId', ordinal, 'string', 'projects/p/traces/' || trace_id FROM logs WHERE trace_id IS NOT NULL UNION ALL SELECT '$.spanId', ordinal, 'string', span_id FROM logs WHERE span_id IS NOT NULL
  UNION ALL SELECT '$.value', ordinal, CASE WHEN value = floor(value) THEN 'integer' ELSE 'number' END, regexp_replace(CAST(value AS VARCHAR), '[.]0$', '') FROM logs WHERE value IS NOT NULL
  UNION ALL SELECT '$.props', ordinal, 'object', '{"k":' || k || '}' FROM logs UNION ALL SELECT '$.props.k', ordinal, 'integer', CAST(k AS VARCHAR) FROM logs
  UNION ALL SELECT '$.mixed', ordinal, mixed_kind, mixed_text FROM logs WHERE mixed_kind IS NOT NULL UNION ALL SELECT '$.mixed[0]', ordinal, 'integer', CAST(ordinal % 5 AS VARCHAR) FROM logs WHERE mixed_kind = 'array'
  UNION ALL SELECT '$.mixed[1]', ordinal, 'integer', '2' FROM logs WHERE mixed_kind = 'array' UNION ALL SELECT '$.mixed.k', ordinal, 'integer', CAST(ordinal % 3 AS VARCHAR) FROM logs WHERE mixed_kind = 'object'
  UNION ALL SELECT '$["odd key"]', ordinal, 'integer', CAST(ordinal % 4 AS VARCHAR) FROM logs)"""


@query("j03_display_path", f"WITH {PATHS} SELECT 'app-log' AS source, display, count(*) AS n FROM n GROUP BY ALL")
def j03(spark, sf):
    flat = S.flatten_paths(log_records(spark, sf), depth=2)
    return flat.groupBy(F.col("source_id").alias("source"), "display").agg(F.count(F.lit(1)).alias("n"))


@query("j04_searchable_text", f"WITH {LOGS} SELECT ordinal, mixed_text AS body FROM logs")
def j04(spark, sf):
    return log_records(spark, sf).select("ordinal", J.searchable_text(F.col("text"), F.col("value"), "mixed").alias("body"))


@query("j05_cell", f"""WITH {LOGS} SELECT ordinal, mixed_kind AS kind, CASE WHEN mixed_kind NOT IN ('array', 'object') THEN mixed_text END AS val,
  CASE WHEN mixed_kind IN ('array', 'object') THEN mixed_text END AS preview, false AS truncated FROM logs""")
def j05(spark, sf):
    c = J.cell(F.col("text"), F.col("value"), "mixed")
    return log_records(spark, sf).select("ordinal", c.alias("c")).select("ordinal", "c.kind", F.col("c.value").alias("val"), "c.preview", "c.truncated")


@query("j06_record_summary", """SELECT doc_id AS ordinal, CASE WHEN doc_id % 5 = 0 THEN '(blank record)' WHEN doc_id % 5 = 1
  THEN '(invalid JSON) {"doc":' || doc_id ELSE '{"doc":' || doc_id || '}' END AS label FROM documents""")
def j06(spark, sf):
    df = table(spark, sf, "documents").select(F.lit("d").alias("source_id"), F.col("doc_id").alias("ordinal"), F.expr(
        "CASE WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 5 = 1 THEN '{\"doc\":' || doc_id ELSE '{\"doc\":' || doc_id || '}' END").alias("text"))
    return R.classify(df).select("ordinal", R.record_summary(F.col("text"), F.col("parse_state")).alias("label"))


DOC_FLAT = r"trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]+', ' ', 'g'), '[  ]+', ' ', 'g'), ' ')"


@query("j07_bounded_summary", f"""SELECT doc_id AS ordinal, CASE WHEN length(s) > 240 THEN substr(s, 1, 237) || '...' WHEN s = '' THEN 'Record' ELSE s END AS summary
  FROM (SELECT doc_id, {DOC_FLAT.replace("text,", "lang || ': ' || text,")} AS s FROM documents)""")
def j07(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.expr("to_variant_object(struct(doc_id AS id, text AS text))").alias("v"))
    return docs.select(F.col("doc_id").alias("ordinal"), J.bounded_summary(F.col("v"), F.col("lang")).alias("summary"))


@query("j08_extract_text", "SELECT conv_id, turn, role || ' ' || text || ' tail' AS joined FROM conversations")
def j08(spark, sf):
    conv = table(spark, sf, "conversations")
    blocks = F.expr("""parse_json(to_json(array(role, NULL, struct('text' AS type, text AS text))))""")
    blocks = F.expr("parse_json('[' || to_json(struct(role AS content)) || ',7,' || to_json(struct('text' AS type, text AS text)) || ',\"tail\"]')")
    return conv.select("conv_id", "turn", J.extract_text(blocks).alias("joined"))


@query("j09_first_present", f"""WITH {LOGS} SELECT ordinal, COALESCE(CASE WHEN mixed_kind <> 'null' THEN mixed_text END, service, logger) AS first FROM logs""")
def j09(spark, sf):
    v = F.col("value")
    leaf = J.first_present(v, ("mixed",), ("nowhere", 3), ("service",), ("logger",))
    return log_records(spark, sf).select("ordinal", F.coalesce(J.scalar_text(leaf), J.as_string(leaf)).alias("first"))


def usage_records(spark, sf):
    """Token counters under rotating alias names, from the order lines."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("""parse_json(CASE l_linenumber % 3
      WHEN 0 THEN to_json(struct(l_partkey AS input_tokens, l_suppkey AS output_tokens, l_linenumber AS cache_read_input_tokens))
      WHEN 1 THEN to_json(struct(l_partkey AS inputTokens, l_suppkey AS output, l_partkey + l_suppkey AS total))
      ELSE to_json(struct(l_partkey AS inputOther, l_suppkey AS inputCacheRead, l_linenumber AS output)) END)""").alias("v"))
    return li


@query("j10_usage", """SELECT sum(CASE WHEN l_linenumber % 3 <> 2 THEN l_partkey END)::DOUBLE AS input, sum(CASE WHEN l_linenumber % 3 <> 2 THEN l_suppkey ELSE l_linenumber END)::DOUBLE AS output,
  sum(CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber END)::DOUBLE AS cached, sum(CASE WHEN l_linenumber % 3 = 1 THEN l_partkey + l_suppkey END)::DOUBLE AS total FROM lineitem""")
def j10(spark, sf):
    u = usage_records(spark, sf).select(J.usage(F.col("v")).alias("u")).select("u.*")
    return u.agg(*[F.sum(c).alias(c) for c in ("input", "output", "cached", "total")])


@query("j11_usage_generic", """SELECT sum(CASE WHEN l_linenumber % 3 <> 2 THEN l_partkey ELSE l_partkey + l_suppkey END)::DOUBLE AS input, sum(CASE WHEN l_linenumber % 3 <> 2 THEN l_suppkey ELSE l_linenumber END)::DOUBLE AS output,
  sum(CASE l_linenumber % 3 WHEN 0 THEN l_linenumber WHEN 2 THEN l_suppkey END)::DOUBLE AS cached,
  sum(l_partkey + l_suppkey + CASE WHEN l_linenumber % 3 = 2 THEN l_linenumber ELSE 0 END)::DOUBLE AS total FROM lineitem""")
def j11(spark, sf):
    u = usage_records(spark, sf).select(J.usage_generic(F.col("v")).alias("u")).select("u.*")
    return u.agg(*[F.sum(c).alias(c) for c in ("input", "output", "cached", "total")])


@query("j12_to_epoch_ms", f"WITH {LOGS} SELECT ordinal, ms FROM logs")
def j12(spark, sf):
    return log_records(spark, sf).select("ordinal", T.to_epoch_ms(J.get(F.col("value"), "timestamp")).cast("bigint").alias("ms"))


@query("j12_epoch_units", """SELECT event_id, (epoch_us(ts) // 1000) AS from_ms, (epoch_us(ts) // 1000) AS from_us, (epoch_us(ts) // 1000) AS from_ns, (epoch_us(ts) // 1000) // 1000 * 1000 AS from_s,
  (epoch_us(ts) // 1000) AS digits, -(epoch_us(ts) // 1000) AS negative FROM events""")
def j12b(spark, sf):
    ev = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    def auto(sql: str):
        return T.to_epoch_ms(F.expr(f"parse_json({sql})")).cast("bigint")
    return ev.select(
        "event_id", auto("cast(us div 1000 AS string)").alias("from_ms"), auto("'\"' || us || '\"'").alias("from_us"),
        auto("'\"' || us || '123\"'").alias("from_ns"), auto("cast(us div 1000000 AS string)").alias("from_s"),
        T.text_to_ms(F.expr("' ' || us || ' '"), "us").cast("bigint").alias("digits"), T.text_to_ms(F.expr("'-' || us"), "auto").cast("bigint").alias("negative"),
    )


@query("j13_metadata_time", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (epoch_us(ts) // 1000) // 1000 * 1000 ELSE (epoch_us(ts) // 1000) END AS ms FROM events")
def j13(spark, sf):
    ev = table(spark, sf, "events").withColumn("m", F.unix_millis(F.col("ts").cast("timestamp")))
    return ev.select("event_id", T.metadata_time(F.expr("parse_json(cast(if(event_id % 2 = 0, m div 1000, m) AS string))")).cast("bigint").alias("ms"))


@query("j14_is_rfc3339", """SELECT event_id, event_id % 6 IN (0, 5) AS ok FROM events""")
def j14(spark, sf):
    ev = table(spark, sf, "events").withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    t = F.expr("""CASE event_id % 6 WHEN 0 THEN iso WHEN 1 THEN substr(iso, 1, 10) WHEN 2 THEN '2024-02-30' || substr(iso, 11)
      WHEN 3 THEN substr(iso, 1, 10) || 'T24:00:00Z' WHEN 4 THEN 'x' || iso ELSE substr(iso, 1, 19) || '+05:30' END""")
    return ev.select("event_id", T.is_rfc3339(t).alias("ok"))


@query("j15_unix_seconds", "SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN (epoch_us(ts) // 1000) // 1000 END AS seconds FROM events")
def j15(spark, sf):
    ev = table(spark, sf, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    v = F.expr("parse_json(CASE event_id % 3 WHEN 2 THEN '-' || s ELSE s || if(event_id % 3 = 1, '.0', '') END)")
    return ev.select("event_id", F.unix_seconds(T.unix_seconds(v)).alias("seconds"))


@query("j20_log_level", f"WITH {LOGS} SELECT ordinal, severity AS level, COALESCE(severity = 'error', false) AS is_error FROM logs")
def j20(spark, sf):
    level = log_level(J.get(F.col("value"), "level"))
    return log_records(spark, sf).select("ordinal", level.alias("level"), severity_is_error_log(level).alias("is_error"))


@query("j21_trace_id", f"WITH {LOGS} SELECT ordinal, trace_id FROM logs")
def j21(spark, sf):
    return log_records(spark, sf).select("ordinal", trace_id(J.string_at(F.col("value"), "traceId")).alias("trace_id"))


@query("j22_content_state", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'present' WHEN 1 THEN 'empty' WHEN 2 THEN 'missing' WHEN 3 THEN 'present'
  WHEN 4 THEN 'empty' ELSE 'missing' END AS state FROM documents""")
def j22(spark, sf):
    v = F.expr("""parse_json(CASE doc_id % 6 WHEN 0 THEN to_json(struct(struct(text AS value) AS content)) WHEN 1 THEN '{"text":""}'
      WHEN 2 THEN 'null' WHEN 3 THEN to_json(array(lang)) WHEN 4 THEN '{"content":{"value":[]}}' ELSE '{"content":null,"text":null}' END)""")
    return table(spark, sf, "documents").select("doc_id", J.content_state(v).alias("state"))


@query("j23_role_of", """SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN 'unknown' ELSE role END AS role FROM conversations""")
def j23(spark, sf):
    named = F.expr("""CASE WHEN turn % 5 = 3 THEN 'narrator' WHEN role = 'user' AND turn % 2 = 0 THEN 'Human' WHEN role = 'assistant' THEN 'GPT'
      WHEN role = 'system' THEN 'developer' ELSE role END""")
    return table(spark, sf, "conversations").select("conv_id", "turn", J.role_of(named.cast("variant")).alias("role"))


# ---- F: predicates -----------------------------------------------------------


def leaf(op: str, path: list, value=None, **more) -> dict:
    return {"op": op, "path": path, "value": value, **more}


PREDICATES = {
    "f01_and": ({"op": "and", "args": [leaf("eq", ["level"], "error"), leaf("gt", ["value"], 10)]}, "severity = 'error' AND value > 10"),
    "f01_or": ({"op": "or", "args": [leaf("eq", ["level"], "error"), leaf("is_null", ["mixed"])]}, "severity = 'error' OR mixed_kind = 'null'"),
    "f02_not": ({"op": "not", "arg": leaf("eq", ["service"], "svc-3")}, "service IS DISTINCT FROM 'svc-3'"),
    "f03_eq_string": (leaf("eq", ["level"], "error"), "severity = 'error'"),
    "f03_eq_number": (leaf("eq", ["mixed"], 7), "mixed_num = 7"),
    "f03_eq_boolean": (leaf("eq", ["mixed"], True), "mixed_bool"),
    "f03_eq_null": (leaf("eq", ["mixed"], None), "mixed_kind = 'null'"),
    "f04_ne": (leaf("ne", ["mixed"], 7), "mixed_kind IS NOT NULL AND mixed_num IS DISTINCT FROM 7"),
    "f05_lt": (leaf("lt", ["mixed"], 20.5), "mixed_num < 20.5"),
    "f06_lte": (leaf("lte", ["mixed"], 20), "mixed_num <= 20"),
    "f07_gt": (leaf("gt", ["mixed"], "s5"), "mixed_str > 's5'"),
    "f08_gte": (leaf("gte", ["value"], 12.5), "value >= 12.5"),
    "f09_contains": (leaf("contains", ["message"], "USER 1", ignore_case=True), "contains(lower(message), 'user 1')"),
    "f10_starts_with": (leaf("starts_with", ["message"], "error"), "starts_with(message, 'error')"),
    "f11_ends_with": (leaf("ends_with", ["message"], "7"), "ends_with(message, '7')"),
    "f12_exists": (leaf("exists", ["mixed"]), "mixed_kind IS NOT NULL"),
    "f13_is_null": (leaf("is_null", ["mixed"]), "mixed_kind = 'null'"),
    "f14_kind_is": (leaf("kind_is", ["mixed"], "integer"), "mixed_kind = 'integer'"),
    "f15_text_search": ({"op": "text_search", "value": '"service":"SVC-2","logger":"app.v'}, "service = 'svc-2' AND event_type = 'view'"),
    "f16_text_search_paths": ({"op": "text_search", "value": "k\":1", "paths": [["mixed"], ["props"]]},
                              "contains(mixed_text, 'k\":1') OR contains('{\"k\":' || k || '}', 'k\":1')"),
    "f23_row_types": (W.row_types(["type"], ["error", "signup"]), "event_type IN ('error', 'signup')"),
    "f24_compose": (W.compose({"op": "text_search", "value": "app.click"}, W.column_filter(["value"], "number", "lt", 20), None,
                              W.column_filter(["service"], "text", "not_contains", "SVC-1"), W.row_types(["type"], ["click", "view"])),
                    "event_type = 'click' AND value < 20 AND service IS DISTINCT FROM 'svc-1'"),
}


def _predicate_query(name: str, tree: dict, sql: str) -> None:
    @query(name, f"WITH {LOGS} SELECT ordinal, event_type AS type FROM logs WHERE {sql}")
    def run(spark, sf):
        return W.where(log_records(spark, sf), tree).select("ordinal", J.string_at(F.col("value"), "type").alias("type"))


for _name, (_tree, _sql) in PREDICATES.items():
    _predicate_query(_name, _tree, _sql)

COLUMN_FILTERS = {
    "text-contains": (["message"], "text", "contains", "Click"), "text-eq": (["service"], "text", "eq", "svc-4"), "text-empty": (["service"], "text", "empty", None),
    "number-gte": (["mixed"], "number", "gte", 30), "number-on-text": (["service"], "number", "gt", "x"), "boolean-ne": (["mixed"], "boolean", "ne", True),
}


@query("f22_column_filters", f"""WITH {LOGS} SELECT 'text-contains' AS filter, count(*) FILTER (contains(lower(message), 'click')) AS n FROM logs
  UNION ALL SELECT 'text-eq', count(*) FILTER (service = 'svc-4') FROM logs UNION ALL SELECT 'text-empty', count(*) FILTER (service IS NULL) FROM logs
  UNION ALL SELECT 'number-gte', count(*) FILTER (mixed_num >= 30) FROM logs UNION ALL SELECT 'number-on-text', count(*) FROM logs
  UNION ALL SELECT 'boolean-ne', count(*) FILTER (mixed_kind IS NOT NULL AND mixed_bool IS DISTINCT FROM true) FROM logs""")
def f22(spark, sf):
    logs = log_records(spark, sf)
    hits = [F.count_if(W.condition(W.compose(W.column_filter(*spec)))).alias(name) for name, spec in COLUMN_FILTERS.items()]
    one = logs.filter(F.col("value").isNotNull()).agg(*hits)
    return one.unpivot([], list(COLUMN_FILTERS), "filter", "n")


EVENT_PREDICATES = {
    "f17_profile_field": ({"op": "profile_field", "field": "severity", "compare": "ne", "value": "info"}, f"{IS_LOG} AND severity <> 'info'"),
    "f18_profile_text": ({"op": "profile_text", "field": "service", "match": "ends_with", "value": "5"}, f"{IS_LOG} AND ends_with(service, '5')"),
    "f19_profile_exists": ({"op": "profile_exists", "field": "traceId"}, f"{IS_LOG} AND trace_id IS NOT NULL"),
    "f20_profile_is_null": ({"op": "not", "arg": {"op": "profile_is_null", "field": "service"}}, "true"),
    "f21_profile_namespace": ({"op": "and", "args": [
        {"op": "profile_field", "field": "actor", "compare": "eq", "value": "system"}, {"op": "profile_field", "field": "logger", "compare": "gt", "value": "app.d"},
        {"op": "profile_text", "field": "summary", "match": "contains", "value": "USER 2", "ignore_case": True}]}, f"{IS_LOG} AND logger > 'app.d' AND contains(message, 'user 2')"),
}


def _event_query(name: str, tree: dict, sql: str) -> None:
    @query(name, f"WITH {LOGS} SELECT ordinal FROM logs WHERE {sql}")
    def run(spark, sf):
        return log_events(spark, sf).filter(W.condition(tree)).select("ordinal")


for _name, (_tree, _sql) in EVENT_PREDICATES.items():
    _event_query(_name, _tree, _sql)

# ---- P: projection, O: order and pages ----------------------------------------


@query("p01_flatten_paths", f"""WITH {LOGS}, paths AS (
  SELECT ordinal, unnest(list_filter(['$', '$.type', '$.value', '$.logger', '$.requestId', '$.props', '$.props.k', '$["odd key"]',
    CASE WHEN ordinal % 13 <> 1 THEN '$.timestamp' END, CASE WHEN severity IS NOT NULL THEN '$.level' END, CASE WHEN message IS NOT NULL THEN '$.message' END,
    CASE WHEN service IS NOT NULL THEN '$.service' END, CASE WHEN trace_id IS NOT NULL THEN '$.traceId' END, CASE WHEN span_id IS NOT NULL THEN '$.spanId' END,
    CASE WHEN mixed_kind IS NOT NULL THEN '$.mixed' END, CASE WHEN mixed_kind = 'array' THEN '$.mixed[0]' END, CASE WHEN mixed_kind = 'array' THEN '$.mixed[1]' END,
    CASE WHEN mixed_kind = 'object' THEN '$.mixed.k' END], lambda x: x IS NOT NULL)) AS display FROM logs) SELECT ordinal, display FROM paths""")
def p01(spark, sf):
    return S.flatten_paths(log_records(spark, sf)).select("ordinal", "display")


@query("p02_select_columns", f"""WITH {LOGS} SELECT ordinal, message AS message, mixed_kind AS mixed_kind, mixed_text AS mixed, ordinal AS position FROM logs""")
def p02(spark, sf):
    out = P.select_columns(log_records(spark, sf), [{"id": "message", "path": ["message"]}, {"id": "mixed", "path": ["mixed"]}, {"id": "position", "field": "ordinal"}])
    return out.select("ordinal", F.col("message.value").alias("message"), F.col("mixed.kind").alias("mixed_kind"),
                      F.coalesce("mixed.value", "mixed.preview").alias("mixed"), "position")


@query("p03_suggest_columns", f"""WITH {LOGS}, n AS (SELECT '$.' || name AS display, seen FROM (SELECT count(*) AS type, count(*) AS value, count(*) AS logger, count(*) AS "requestId", count(*) AS props,
  count(*) FILTER (ordinal % 13 <> 1) AS "timestamp", count(severity) AS level, count(message) AS message, count(service) AS service, count(trace_id) AS "traceId", count(span_id) AS "spanId",
  count(mixed_kind) AS mixed FROM logs) UNPIVOT (seen FOR name IN (type, value, logger, "requestId", props, "timestamp", level, message, service, "traceId", "spanId", mixed))
  UNION ALL SELECT '$["odd key"]', count(*) FROM logs) SELECT display, seen FROM n ORDER BY seen DESC, display LIMIT 12""")
def p03(spark, sf):
    return S.suggest_columns(log_records(spark, sf), 12)


@query("p04_default_columns", f"""WITH {LOGS} SELECT ordinal, severity AS custom, CASE WHEN {IS_LOG} THEN timestamp_raw END AS timestamp_raw, CASE WHEN {IS_LOG} THEN severity END AS severity,
  CASE WHEN {IS_LOG} THEN logger || ': ' || message END AS summary, CASE WHEN {IS_LOG} THEN service END AS derived_service, CASE WHEN {IS_LOG} THEN logger END AS derived_logger FROM logs""")
def p04(spark, sf):
    recs = log_records(spark, sf)
    ev = APP_LOG.project(recs, keep=("source_id", "ordinal", "text", "value"))
    out = P.select_columns(ev, P.default_columns(APP_LOG.id, [{"id": "custom", "path": ["level"]}]))
    out = out.withColumn("custom", log_level(F.col("custom.value").cast("variant")))
    fixed = F.when(F.col("custom") == "30", "info").otherwise(F.col("custom"))
    return out.select("ordinal", fixed.alias("custom"), "timestamp_raw", "severity",
                      F.when(F.col("severity").isNotNull(), F.col("summary")).alias("summary"), "derived_service", "derived_logger")


@query("o01_page_forward", f"WITH {LOGS} SELECT ordinal, event_type AS type, true AS has_after FROM logs WHERE ordinal > 120 AND service = 'svc-1' ORDER BY ordinal LIMIT 25")
def o01(spark, sf):
    hit = W.where(log_records(spark, sf), leaf("eq", ["service"], "svc-1"))
    return P.page_forward(hit, 120, 25).select("ordinal", J.string_at(F.col("value"), "type").alias("type"), "has_after")


@query("o02_page_backward", f"WITH {LOGS} SELECT * FROM (SELECT ordinal, event_type AS type, true AS has_before FROM logs WHERE ordinal < 900 AND service = 'svc-1' ORDER BY ordinal DESC LIMIT 25)")
def o02(spark, sf):
    hit = W.where(log_records(spark, sf), leaf("eq", ["service"], "svc-1"))
    return P.page_backward(hit, 900, 25).select("ordinal", J.string_at(F.col("value"), "type").alias("type"), "has_before")


@query("o03_page_by_ordinal", f"WITH {LOGS} SELECT ordinal, event_type AS type FROM logs WHERE severity = 'error' ORDER BY ordinal DESC LIMIT 40 OFFSET 60")
def o03(spark, sf):
    hit = W.where(log_records(spark, sf), leaf("eq", ["level"], "error"))
    return P.page_by_ordinal(hit, 60, 40, descending=True).select("ordinal", J.string_at(F.col("value"), "type").alias("type"))


@query("o04_top_page", f"WITH {LOGS} SELECT ordinal, value, row_number() OVER (ORDER BY value DESC, ordinal) AS position FROM logs ORDER BY value DESC, ordinal LIMIT 50 OFFSET 30")
def o04(spark, sf):
    out = P.top_page(log_records(spark, sf), ["value"], 30, 50, descending=True)
    return out.select("ordinal", J.number_at(F.col("value"), "value").alias("value"), (F.col("position") + 30).cast("bigint").alias("position"))


MIXED_ORDER = "(mixed_kind IS NULL OR mixed_kind = 'null'), CASE mixed_kind WHEN 'array' THEN 1 WHEN 'boolean' THEN 2 WHEN 'integer' THEN 3 WHEN 'number' THEN 3 WHEN 'object' THEN 4 WHEN 'string' THEN 5 END {0}, mixed_num {0}, mixed_bool {0}, CASE WHEN mixed_kind IN ('array', 'object', 'string') THEN mixed_text END {0}, ordinal"


@query("o05_mixed_order", f"""WITH {LOGS} SELECT ordinal, row_number() OVER (ORDER BY {MIXED_ORDER.format('DESC')}) AS position FROM logs""")
def o05(spark, sf):
    return P.with_positions(P.sort_mixed(log_records(spark, sf), ["mixed"], descending=True).select("ordinal")).select("ordinal", "position")


@query("o06_sort_column", f"""WITH {LOGS} SELECT ordinal, severity, row_number() OVER (ORDER BY severity NULLS LAST, ordinal) AS position FROM (SELECT ordinal, CASE WHEN {IS_LOG} THEN severity END AS severity FROM logs)""")
def o06(spark, sf):
    # A sort reads its input twice, first to find the ranges: the records are parsed once, before.
    events = materialize(log_events(spark, sf).select("ordinal", "severity"), "events")
    return P.with_positions(P.sort_by(events, "severity"))


@query("o07_matched_total", f"WITH {LOGS} SELECT count(*) AS matched FROM logs WHERE severity = 'error'")
def o07(spark, sf):
    return P.matched_total(W.where(log_records(spark, sf), leaf("eq", ["level"], "error")))


def sized(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.lit("documents").alias("source_id"), F.col("doc_id").alias("ordinal"), "text", F.octet_length("text").cast("bigint").alias("content_len"))


@query("o08_budget", """SELECT count(*) AS records, CAST(max(c) AS BIGINT) AS bytes, count(*) AS cursor, 'byte-budget' AS reason FROM (
  SELECT sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS c FROM documents) WHERE c <= 200000""")
def o08(spark, sf):
    return P.budget(sized(spark, sf), 100_000, 200_000)


@query("o09_within_bytes", """WITH s AS (SELECT doc_id, CASE WHEN doc_id < 2 THEN 0 WHEN doc_id = 2 THEN 400000 ELSE octet_length(encode(text)) END AS n, doc_id % 2 AS source FROM documents),
  r AS (SELECT source, doc_id, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS c FROM s) SELECT source, doc_id AS ordinal, CAST(c AS BIGINT) AS cumulative FROM r WHERE c <= 300000""")
def o09(spark, sf):
    """Two sources that begin with an empty row; in one the next row alone is over the limit and ends the page."""
    df = sized(spark, sf).withColumn("content_len", F.expr("CASE WHEN ordinal < 2 THEN 0 WHEN ordinal = 2 THEN 400000 ELSE content_len END")).withColumn("source_id", (F.col("ordinal") % 2).cast("string"))
    return P.within_bytes(df, 300_000).select(F.col("source_id").cast("bigint").alias("source"), "ordinal", "cumulative")


@query("w03_running_bytes", """SELECT doc_id AS ordinal, CAST(sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS BIGINT) AS cumulative FROM documents""")
def w03(spark, sf):
    return P.running_bytes(sized(spark, sf), blocks=128).select("ordinal", "cumulative")


# ---- H: schema -----------------------------------------------------------------


@query("h01_field_stats", f"""WITH {PATHS}
  SELECT display, count(*) AS seen, count(*) FILTER (kind = 'integer') AS integers, count(*) FILTER (kind = 'string') AS strings, count(*) FILTER (kind = 'number') AS numbers, count(*) FILTER (kind = 'null') AS nulls,
    (SELECT count(*) FROM logs) - count(*) AS missing, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal FROM n GROUP BY display""")
def h01(spark, sf):
    st = S.field_stats(log_records(spark, sf))
    return st.select("display", "seen", F.col("kind_integer").alias("integers"), F.col("kind_string").alias("strings"), F.col("kind_number").alias("numbers"), "nulls", "missing", "first_ordinal", "last_ordinal")


@query("h01_examples", f"""WITH {PATHS}, g AS (SELECT display, t, min(ordinal) AS f, row_number() OVER (PARTITION BY display ORDER BY min(ordinal)) AS rn FROM n WHERE t IS NOT NULL GROUP BY display, t)
  SELECT display, string_agg(t, '|' ORDER BY f) AS examples FROM g WHERE rn <= 3 GROUP BY display""")
def h01b(spark, sf):
    """Three examples of every path below the record; those of whole records have no statement in SQL."""
    return S.field_stats(log_records(spark, sf)).filter(F.col("display") != "$").select("display", F.array_join("examples", "|").alias("examples"))


@query("h02_schema_summary", """SELECT count(*) AS observed, count(*) FILTER (doc_id % 5 > 1) AS valid, count(*) FILTER (doc_id % 5 <= 1) AS problem, true AS complete FROM documents""")
def h02(spark, sf):
    df = table(spark, sf, "documents").select(F.lit("d").alias("source_id"), F.col("doc_id").alias("ordinal"), F.expr(
        "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN text || '{' ELSE to_json(struct(text)) END").alias("text"))
    return S.schema_summary(R.classify(df))


@query("h03_discover_shape", f"""WITH {LOGS} SELECT '$.type' AS display, count(*) AS records, 'string' AS kinds, count(DISTINCT event_type) AS distinct_strings,
  (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_value FROM logs
  UNION ALL SELECT '$.mixed', count(mixed_kind), 'array,boolean,integer,null,number,object,string', count(DISTINCT mixed_str),
  (SELECT mixed_str FROM logs WHERE mixed_str IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM logs""")
def h03(spark, sf):
    shape = S.discover_shape(log_records(spark, sf)).filter(F.col("display").isin("$.type", "$.mixed"))
    return shape.select("display", "records", "kinds", "distinct_strings", F.get("top_strings", F.lit(0))["short"].alias("top_value"))


@query("h04_infer_discriminator", "SELECT '$.type' AS display, 0.95 + 0.25 + 0.15 AS score FROM (SELECT count(*) FROM events)")
def h04(spark, sf):
    logs = log_records(spark, sf)
    return S.infer_discriminator(S.discover_shape(logs), logs.agg(F.count("value").alias("total"))).select("display", F.round("score", 2).alias("score"))


@query("h05_record_signals", f"""WITH {LOGS} SELECT ordinal, '$.type' AS discriminator_path, event_type AS discriminator_value,
  CASE WHEN ordinal % 13 NOT IN (1, 2) THEN timestamp_raw END AS timestamp_value,
  CASE WHEN message IS NOT NULL THEN message END AS message, '$.requestId' AS identity FROM logs""")
def h05(spark, sf):
    sig = S.record_signals(log_records(spark, sf))
    message = F.when(F.col("summary_path") == "$.message", F.col("summary_value"))
    return sig.select("ordinal", "discriminator_path", "discriminator_value", "timestamp_value", message.alias("message"), F.get("identities", F.lit(0))["path"].alias("identity"))


@query("h06_path_tree", f"""WITH {PATHS}, p AS (SELECT regexp_replace(display, '\\[[0-9]+\\]', '[]') AS path, count(*) AS seen FROM n GROUP BY 1),
  q AS (SELECT path, seen, CASE WHEN path = '$' THEN NULL WHEN path LIKE '%"]' THEN '$' ELSE regexp_replace(path, '([.][A-Za-z]+|\\[\\])$', '') END AS parent FROM p)
  SELECT path, parent, seen, (SELECT count(*) FROM q c WHERE c.parent = q.path) AS children FROM q""")
def h06(spark, sf):
    return S.path_tree(S.field_stats(log_records(spark, sf)))


@query("h07_row_types", f"WITH {LOGS} SELECT DISTINCT event_type AS row_type, 'type' AS origin FROM logs UNION ALL SELECT 'log', 'event_kind' FROM (SELECT count(*) FROM logs) UNION ALL SELECT 'other', 'event_kind' FROM (SELECT count(*) FROM logs)")
def h07(spark, sf):
    logs = log_records(spark, sf)
    return S.row_type_values(logs, APP_LOG.project(logs))


# ---- A: insights ---------------------------------------------------------------


@query("n13_application_log", f"""WITH {LOGS} SELECT ordinal, CASE WHEN {IS_LOG} THEN 'log' ELSE 'other' END AS event_kind, CASE WHEN {IS_LOG} THEN timestamp_raw END AS timestamp_raw,
  CASE WHEN {IS_LOG} THEN 'system' END AS actor, CASE WHEN {IS_LOG} THEN severity END AS severity, CASE WHEN {IS_LOG} THEN COALESCE(trace_id, request_id) END AS session_id,
  CASE WHEN {IS_LOG} THEN span_id END AS turn_id, CASE WHEN {IS_LOG} THEN logger || ': ' || message END AS summary, CASE WHEN {IS_LOG} THEN service END AS service,
  CASE WHEN {IS_LOG} THEN ms END AS ms, CASE WHEN {IS_LOG} THEN 'source' ELSE 'inferred' END AS confidence FROM logs""")
def n13(spark, sf):
    e = log_events(spark, sf)
    return e.select("ordinal", "event_kind", "timestamp_raw", "actor", "severity", "session_id", "turn_id", F.when(F.col("event_kind") == "log", F.col("summary")).alias("summary"),
                    J.as_string(F.element_at("derived", "service")).alias("service"), F.unix_millis("ts").alias("ms"), "confidence")


@query("n01_generic", f"""WITH {LOGS} SELECT ordinal, 'other' AS event_kind, CASE WHEN ordinal % 13 NOT IN (1, 2) THEN timestamp_raw END AS timestamp_raw,
  CASE WHEN message IS NOT NULL THEN event_type || ': ' || message END AS summary, event_type AS detected_type, request_id AS detected_identity, 'source' AS confidence FROM logs""")
def n01(spark, sf):
    e = project_generic(log_records(spark, sf))
    has_message = F.exists("evidence", lambda x: (x["field"] == "summary") & (x["path"] == "$.message"))
    return e.select("ordinal", "event_kind", "timestamp_raw", F.when(has_message, F.col("summary")).alias("summary"), J.as_string(F.element_at("derived", "detectedType")).alias("detected_type"),
                    J.as_string(F.element_at("derived", "detectedIdentity")).alias("detected_identity"), "confidence")


@query("a01_select_value", f"""WITH {LOGS} SELECT ordinal, CASE WHEN severity IS NULL THEN 'missing' WHEN severity = 'Unknown' THEN 'unknown' ELSE 'value' END AS level_state,
  CASE WHEN mixed_kind IS NULL OR mixed_kind = 'null' THEN 'missing' WHEN mixed_kind IN ('array', 'object') THEN 'unknown' ELSE 'value' END AS mixed_state,
  CASE WHEN mixed_kind IN ('integer', 'number') THEN 'number' WHEN mixed_kind IN ('string', 'boolean') THEN mixed_kind END AS mixed_type,
  CASE WHEN mixed_kind IN ('integer', 'number', 'string', 'boolean') THEN mixed_text END AS mixed_label FROM logs""")
def a01(spark, sf):
    level, mixed = A.selector(["level"]), A.selector(["mixed"])
    return log_records(spark, sf).select("ordinal", level["state"].alias("level_state"), mixed["state"].alias("mixed_state"), mixed["type"].alias("mixed_type"), mixed["label"].alias("mixed_label"))


FOLD = """f AS (SELECT kind, type, label, n, row_number() OVER (PARTITION BY kind ORDER BY first, type, label) AS rn, first FROM (
  SELECT kind, CASE WHEN kind = 'value' THEN type END AS type, CASE WHEN kind = 'value' THEN label END AS label, count(*) AS n, min(ordinal) AS first FROM s GROUP BY 1, 2, 3)),
  r AS (SELECT CASE WHEN kind = 'value' AND rn > {cap} THEN 'other' ELSE kind END AS kind, CASE WHEN kind = 'value' AND rn <= {cap} THEN type END AS type,
  CASE WHEN kind = 'value' AND rn <= {cap} THEN label WHEN kind = 'value' THEN 'Other' WHEN kind = 'unknown' THEN 'Unknown' ELSE 'Missing' END AS label, n FROM f)
  SELECT kind, type, label, CAST(sum(n) AS BIGINT) AS "count" FROM r GROUP BY 1, 2, 3"""
MIXED_STATES = """s AS (SELECT ordinal, CASE WHEN mixed_kind IS NULL OR mixed_kind = 'null' THEN 'missing' WHEN mixed_kind IN ('array', 'object') THEN 'unknown' ELSE 'value' END AS kind,
  CASE WHEN mixed_kind IN ('integer', 'number') THEN 'number' ELSE mixed_kind END AS type, mixed_text AS label FROM logs)"""


@query("a02_category_counts", f"WITH {LOGS}, {MIXED_STATES}, {FOLD.format(cap=29)}")
def a02(spark, sf):
    return A.category_counts(log_records(spark, sf), A.selector(["mixed"]))


@query("a03_category_top", f"WITH {LOGS}, {MIXED_STATES} SELECT type, label, count(*) AS \"count\" FROM s WHERE kind = 'value' GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 20")
def a03(spark, sf):
    return A.category_top(log_records(spark, sf), A.selector(["mixed"]), 20)


BUCKETS = """b AS (SELECT kind, start_ms, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY min(ordinal), start_ms) AS rn FROM t GROUP BY 1, 2),
  r AS (SELECT CASE WHEN kind = 'value' THEN CASE WHEN rn > {cap} THEN 'overflow' ELSE 'time' END ELSE kind END AS kind, CASE WHEN kind = 'value' AND rn <= {cap} THEN start_ms END AS start_ms, n FROM b)"""
TIMES = """t AS (SELECT ordinal, CASE WHEN timestamp_raw IS NULL THEN 'missing' WHEN ms IS NULL THEN 'unknown' ELSE 'value' END AS kind, CAST(floor(ms / {width}) * {width} AS BIGINT) AS start_ms FROM logs)"""


@query("a04_time_buckets", f"""WITH {LOGS}, {TIMES.format(width=3600000)}, {BUCKETS.format(cap=509)}
  SELECT kind, start_ms, start_ms + 3600000 AS end_ms, CAST(sum(n) AS BIGINT) AS "count" FROM r GROUP BY 1, 2""")
def a04(spark, sf):
    out = A.time_buckets(log_records(spark, sf), J.get(F.col("value"), "timestamp"), 3_600_000)
    return out.select("kind", "start_ms", "end_ms", "count")


@query("a05_insights", f"""WITH {LOGS}, e AS (SELECT ordinal, CASE WHEN {IS_LOG} THEN 'log' END AS event_kind, CASE WHEN {IS_LOG} THEN severity END AS severity, CASE WHEN {IS_LOG} THEN service END AS service,
    CASE WHEN {IS_LOG} THEN timestamp_raw END AS raw, CASE WHEN {IS_LOG} THEN ms END AS ms FROM logs),
  d AS (SELECT ordinal, 'event_kind' AS dimension, CASE WHEN event_kind IS NULL THEN 'unknown' ELSE 'value' END AS kind, event_kind AS label, CAST(NULL AS BIGINT) AS start_ms FROM e
    UNION ALL SELECT ordinal, 'severity', CASE WHEN severity IS NULL THEN 'missing' WHEN severity = 'Unknown' THEN 'unknown' ELSE 'value' END, CASE WHEN severity <> 'Unknown' THEN severity END, NULL FROM e
    UNION ALL SELECT ordinal, 'service', CASE WHEN service IS NULL THEN 'missing' ELSE 'value' END, service, NULL FROM e
    UNION ALL SELECT ordinal, 'status', 'missing', NULL, NULL FROM e
    UNION ALL SELECT ordinal, 'time', CASE WHEN raw IS NULL THEN 'missing' WHEN ms IS NULL THEN 'unknown' ELSE 'value' END, NULL, CAST(floor(ms / 300000) * 300000 AS BIGINT) FROM e),
  g AS (SELECT dimension, kind, label, start_ms, count(*) AS n, row_number() OVER (PARTITION BY dimension, kind ORDER BY min(ordinal), label, start_ms) AS rn FROM d GROUP BY 1, 2, 3, 4),
  r AS (SELECT dimension, n, kind = 'value' AND rn > CASE WHEN dimension = 'time' THEN 61 ELSE 29 END AS cut, kind, label, start_ms FROM g)
  SELECT dimension, CASE WHEN cut THEN CASE WHEN dimension = 'time' THEN 'overflow' ELSE 'other' END ELSE kind END AS kind, CASE WHEN NOT cut THEN label END AS label,
    CASE WHEN NOT cut THEN start_ms END AS start_ms, CAST(sum(n) AS BIGINT) AS "count" FROM r GROUP BY 1, 2, 3, 4""")
def a05(spark, sf):
    return A.insights(log_events(spark, sf))


@query("a06_derived_selector", f"""WITH {LOGS}, s AS (SELECT ordinal, CASE WHEN {IS_LOG} AND service IS NOT NULL THEN 'value' ELSE 'missing' END AS kind, 'string' AS type, service AS label FROM logs), {FOLD.format(cap=3)}""")
def a06(spark, sf):
    return A.category_counts(log_events(spark, sf), A.selector("service"), max_groups=6)


FLAGSHIP = f"""WITH {LOGS} SELECT CAST(floor(ms / 300000) * 300000 AS BIGINT) AS start_ms, service, count(*) AS errors
  FROM logs WHERE {IS_LOG} AND severity = 'error' AND contains(lower(message), 'error by user') AND ms IS NOT NULL GROUP BY 1, 2"""


@query("errors_per_bucket_and_service", FLAGSHIP)
def errors_per_bucket(spark, sf):
    """Errors per 5-minute bucket and service, from raw JSON lines."""
    tree = W.compose(leaf("eq", ["level"], "error"), leaf("contains", ["message"], "ERROR BY USER", ignore_case=True))
    events = APP_LOG.project(W.where(log_records(spark, sf), tree)).filter(F.col("ts").isNotNull())
    return events.groupBy(T.bucket_start(F.unix_millis("ts"), 300_000).alias("start_ms"), J.as_string(F.element_at("derived", "service")).alias("service")).agg(
        F.count(F.lit(1)).alias("errors"))


EMBEDDED = """'x' || doc_id || ' {"doc":' || doc_id || ',"s":"}]"} mid [1,{"k":' || doc_id || '}' || CASE doc_id % 3 WHEN 0 THEN ']' WHEN 1 THEN '}' ELSE '' END || ' tail'"""


@query("j27_embedded_json", f"""WITH t AS (SELECT doc_id, {EMBEDDED} AS t, '{{"doc":' || doc_id || ',"s":"}}]"}}' AS a, CASE WHEN doc_id % 3 = 0 THEN '[1,{{"k":' || doc_id || '}}]' ELSE '{{"k":' || doc_id || '}}' END AS b FROM documents)
  SELECT doc_id, (strpos(t, s) - 1)::INTEGER AS start, (strpos(t, s) - 1 + length(s))::INTEGER AS "end", s AS source FROM (SELECT doc_id, t, unnest([a, b]) AS s FROM t)""")
def j27(spark, sf):
    """Two values in prose: one with brackets in a string, one whole, closed by the wrong bracket, or not closed."""
    d = table(spark, sf, "documents").select("doc_id", F.expr(EMBEDDED.replace("doc_id ||", "string(doc_id) ||")).alias("t"))
    return d.select("doc_id", F.inline(embedded_json(F.col("t"))))


# ---- content of texts, fields by meaning, optional parts ------------------------------------

CONTENT = """CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '{"a":[' || doc_id || ']}' WHEN 2 THEN '1: # ' || lang || chr(10) || '2: - ' || source WHEN 3 THEN 'log ' || doc_id || ': {"doc":' || doc_id || '} end' ELSE 'plain ' || lang || ' {not json' END"""
MARKDOWN = " OR ".join(f"regexp_matches(text, '{p}')" for p in (
    r"(?m)^[^\S\n]*#{1,6}[^\S\n]+\S", r"(?m)^[^\S\n]*(`{3,}|~{3,})[^\S\n]*[A-Za-z0-9_+#.-]*[^\S\n]*$", r"(?m)^[^\S\n]*([-*+][^\S\n]+\S|[0-9]+[.)][^\S\n]+\S|>)", r"(?m)^[^\S\n]*((\*[^\S\n]*){3,}|(-[^\S\n]*){3,}|(_[^\S\n]*){3,})$",
    r"(?m)^[^\n|]*\|[^\n]*\n[^\S\n]*\|?[^\S\n]*:?-{3,}:?[^\S\n]*(\|[^\S\n]*:?-{3,}:?[^\S\n]*)+\|?[^\S\n]*$", r"\*\*[^*\n]+\*\*|`[^`\n]+`|\[[^\]\n]+\]\([^)\n]+\)"))


@query("j26_content_class", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN text IS NULL THEN NULL WHEN {MARKDOWN} THEN 'markdown' ELSE 'text' END WHEN 1 THEN 'json' WHEN 2 THEN 'markdown' WHEN 3 THEN 'json' ELSE 'text' END AS kind FROM documents")
def j26(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(CONTENT.replace("doc_id ||", "string(doc_id) ||").replace("chr(10)", "char(10)")).alias("t"))
    return d.select("doc_id", content_class(F.col("t")).alias("kind"))


@query("j26_code_language", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'rust' WHEN 1 THEN 'shell' WHEN 2 THEN 'python' WHEN 3 THEN 'javascript' WHEN 4 THEN lower(lang) END AS language FROM documents")
def j26_language(spark, sf):
    code = F.expr("""CASE doc_id % 6 WHEN 0 THEN 'pub struct A' || doc_id || ';\n1: fn f' || doc_id || '() {}' WHEN 1 THEN 'cargo test ' || lang || '\nif [ -f a ]; then x; fi' WHEN 2 THEN 'import os\ndef f' || doc_id || '(x): pass'
      WHEN 3 THEN 'const a = await ' || source || '();' WHEN 4 THEN text ELSE '1: plain words ' || doc_id END""")
    d = table(spark, sf, "documents")
    return d.select("doc_id", code_language(code, F.expr("if(doc_id % 6 = 4, ' ' || upper(lang) || ' ', null)")).alias("language"))


VOCABULARY = [Feature("content", ("content",), 1.1), Feature("body", ("text", "raw_content")), Feature("list", ("items",), 0.5, ("array",))]


@query("j25_semantic_features", """WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[^ \t\n\r\f\v]') THEN 0.2 ELSE 0 END AS full_text FROM documents),
  f AS (SELECT doc_id, 'content' AS feature, '$.content' AS path, 1.14 AS score, 1 AS len FROM d UNION ALL SELECT doc_id, 'content', '$.content.Content', 1.05 + full_text, 2 FROM d UNION ALL SELECT doc_id, 'body', '$.content["raw-content"]', 1.15, 2 FROM d
    UNION ALL SELECT doc_id, 'list', '$.items', 0.58, 1 FROM d UNION ALL SELECT doc_id, 'body', '$.items[0].TEXT', 1.1, 3 FROM d UNION ALL SELECT doc_id, 'body', '$.items[1].text', 0.9, 3 FROM d)
  SELECT doc_id AS ordinal, feature, path, round(score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, len) AS rank FROM f""")
def j25(spark, sf):
    text = "to_json(named_struct('content', named_struct('type', 'User', 'Content', coalesce(text, ''), 'raw-content', lang), 'items', array(named_struct('TEXT', source, 'text', null), named_struct('TEXT', null, 'text', '')), 'Items', 7))"
    d = spread(table(spark, sf, "documents"))
    records = parse_texts(d.select(F.lit("features").alias("source_id"), F.col("doc_id").alias("ordinal"), F.expr(text).alias("text")))
    return semantic_features(records, VOCABULARY).select("ordinal", "feature", "path", F.round("score", 6).alias("score"), "rank")
