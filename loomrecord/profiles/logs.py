"""Structured application logs. N1: records of no known family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.operators import schema as S
from loomrecord.profiles.base import Profile, actor_from_role, derived, located_path, taken

# Alias paths of each log field, tried in order.
TIME = [("timestamp",), ("time",), ("@timestamp",), ("@t",), ("datetime",), ("timeMillis",), ("instant", "timeMillis")]
LEVEL = [("level",), ("severity",), ("severityText",), ("@l",), ("log", "level")]
LOGGER = [("logger",), ("category",), ("component",), ("loggerName",), ("SourceContext",), ("name",), ("target",), ("log", "logger")]
SERVICE = [("serviceName",), ("service_name",), ("service", "name"), ("resource", "service", "name")]
REQUEST = [("requestId",), ("request_id",), ("RequestId",), ("reqId",), ("http", "request", "id"), ("httpRequest", "requestId")]
CORRELATION = [("correlationId",), ("correlation_id",), ("CorrelationId",)]
TRACE = [("traceId",), ("trace_id",), ("TraceId",), ("trace", "id"), ("logging.googleapis.com/trace",)]
SPAN = [("spanId",), ("span_id",), ("SpanId",), ("span", "id"), ("logging.googleapis.com/spanId",)]
MESSAGE = [("message",), ("msg",), ("@m",), ("@mt",), ("event", "original"), ("fields", "message")]
ERROR = [
    ("exception",), ("Exception",), ("error",), ("err",), ("stack",), ("stacktrace",), ("error", "message"), ("error", "stack"),
    ("error", "stack_trace"), ("exception", "message"), ("exception", "stacktrace"), ("fields", "error"),
    ("fields", "error", "message"), ("fields", "error", "stack"),
]
# Numeric log levels.
LEVEL_NAMES = {"10": "trace", "20": "debug", "30": "info", "40": "warn", "50": "error", "60": "fatal"}


def log_level(value: Column) -> Column:
    """Level text, with numeric levels named."""
    n = F.when(J.is_numeric(value), J.number_text(value))
    return F.when(J.is_string(value) & (F.length(J.as_string(value)) > 0), J.as_string(value)).when(
        n.isNotNull(), F.coalesce(J.lookup(LEVEL_NAMES, n), n)
    )


def severity_is_error_log(level: Column) -> Column:
    """Whether a log level names a failure."""
    named = level.rlike(r"(?i)^(error|fatal|critical|crit|emerg|alert)$")
    return F.coalesce(named | (level.try_cast("double") >= 50), F.lit(False))


def trace_id(text: Column) -> Column:
    """The part after the last /traces/."""
    return F.substring_index(text, "/traces/", -1)


ALIASES = {
    "time": TIME, "level": LEVEL, "logger": LOGGER, "service": SERVICE, "request": REQUEST, "corr": CORRELATION,
    "trace": TRACE, "span": SPAN, "message": MESSAGE, "error": ERROR,
}


# The fields that aliases begin with. Names that begin with a capital stand in a struct of their own.
_KEYS = list(dict.fromkeys(p[0] for paths in ALIASES.values() for p in paths))


def _struct(key: str) -> str:
    return "_u" if key[0].isupper() else "_l"


def _prepare(records: DataFrame) -> DataFrame:
    found = J.fence(records, **{s: J.fields(F.col("value"), *[k for k in _KEYS if _struct(k) == s]) for s in ("_l", "_u")})
    found = J.fence(found, **{f"_{n}_v": taken(_struct, *paths) for n, paths in ALIASES.items()}, _direct=F.expr(J.string_sql("_l.service")))
    texts = {f"_{n}": J.scalar_text(F.col(f"_{n}_v")) for n in ("time", "logger", "request", "corr", "trace", "span")}
    texts["_level"] = log_level(F.col("_level_v"))
    texts["_service"] = F.coalesce(F.col("_direct"), J.scalar_text(F.col("_service_v")))
    found = J.fence(found, **texts)
    payload = F.col("_message_v").isNotNull() | F.col("_error_v").isNotNull()
    origin = F.col("_time").isNotNull() | F.col("_logger").isNotNull() | F.col("_service").isNotNull()
    return found.withColumn("_is_log", payload & F.col("_level").isNotNull() & origin)


def _columns() -> dict:
    log = F.col("_is_log")

    def on_log(c: Column) -> Column:
        return F.when(log, c)

    trace = trace_id(F.col("_trace"))
    source = F.coalesce("_logger", "_service", F.lit("Log"))
    line = J.bounded_summary(F.coalesce("_message_v", "_error_v"), source)
    other = J.bounded_summary(F.col("value"), "Unknown structured-log record")
    var = {k: F.col(f"_{k}").cast("variant") for k in ("logger", "service", "request", "corr", "span")}
    error = F.when(F.col("_error_v").isNotNull(), J.bounded_summary(F.col("_error_v")))
    return {
        "event_kind": F.when(log, "log").otherwise("other"),
        "timestamp_raw": on_log(F.col("_time")),
        "actor": on_log(F.lit("system")),
        "severity": on_log(F.col("_level")),
        "turn_id": on_log(F.col("_span")),
        "session_id": on_log(F.coalesce(F.col("_corr"), trace, F.col("_request"))),
        "summary": F.when(log, line).otherwise(other),
        "confidence": F.when(log, "source").otherwise("inferred"),
        "derived": on_log(derived(
            logger=var["logger"], service=var["service"], requestId=var["request"], correlationId=var["corr"],
            traceId=trace.cast("variant"), spanId=var["span"], exception=error.cast("variant"),
        )),
    }


def _evidence() -> dict[str, Column]:
    log = F.col("_is_log")
    where = {n: located_path("value", *paths) for n, paths in ALIASES.items()}
    where["service"] = F.when(F.col("_direct").isNotNull(), "$.service").otherwise(where["service"])
    return {
        "event_kind": F.when(log, where["level"]),
        "summary": F.when(log, F.coalesce(where["message"], where["error"])).otherwise("$"),
        "actor": F.when(log, F.coalesce(where["logger"], where["service"], where["level"])),
        "timestamp_raw": F.when(log, where["time"]), "severity": F.when(log, where["level"]), "turn_id": F.when(log, where["span"]),
        "session_id": F.when(log, F.coalesce(where["corr"], where["trace"], where["request"])),
    }


def _signals() -> dict[str, Column]:
    payload = F.col("_message_v").isNotNull() | F.col("_error_v").isNotNull()
    source = F.col("_logger").isNotNull() | F.col("_service").isNotNull()
    level, time = F.col("_level").isNotNull(), F.col("_time").isNotNull()
    corr = F.coalesce("_request", "_trace", "_span").isNotNull()
    return {"shapes": payload & level & (time | source), "time": time, "severity": level, "source": source, "correlation": corr}


def _score(s, n):
    score = F.least(F.lit(0.94), 0.44 * F.least(F.lit(1), s["shapes"]) + 0.19 * s["severity"] / n + 0.16 * s["time"] / n
                    + 0.09 * s["source"] / n + 0.06 * s["correlation"] / n)
    return score, (s["shapes"] > 0) & (s["severity"] > 0) & ((s["time"] > 0) | (s["source"] > 0))


APP_LOG = Profile("structured-application-log", "1", _columns, _signals, _score, _prepare, _evidence)


def project_generic(records: DataFrame) -> DataFrame:
    """Kind `other` with the signals found by key meaning (one row per parsed record)."""
    signals = S.record_signals(records)
    joined = records.filter(F.col("value").isNotNull()).join(signals, ["source_id", "ordinal"], "left")
    summary = F.coalesce(F.col("summary_value").cast("variant"), F.col("value"))

    def columns() -> dict:
        return {
            "event_kind": F.lit("other"),
            "timestamp_raw": F.col("timestamp_value"),
            "actor": actor_from_role(F.col("actor_value")),
            "summary": J.bounded_summary(summary, F.col("discriminator_value")),
            "confidence": F.when(F.col("discriminator_path").isNotNull(), "source").otherwise("inferred"),
            "derived": derived(detectedIdentity=F.get("identities", F.lit(0))["value"].cast("variant"), detectedType=F.col("discriminator_value").cast("variant")),
        }

    def evidence() -> dict:
        return {"event_kind": F.col("discriminator_path"), "summary": F.coalesce("summary_path", F.lit("$")),
                "timestamp_raw": F.col("timestamp_path"), "actor": F.col("actor_path")}

    return Profile("generic", "1", columns, evidence=evidence).project(joined, evidence=True)
