"""JSON records derived row by row from the given tables.

Each function gives source_id, ordinal and text, where `text` is one JSON
document per table row. Shapes, missing fields and mixed types follow from the
row's own columns, so the check SQL can state the expected answer without JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrecord.operators.records import parse_texts
from loomrecord.plans.registry import table
from loomrecord.session import deal_rows

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def js(sql: str) -> Column:
    """A variant field from a SQL expression giving JSON text; NULL leaves the field out."""
    return F.expr(f"try_parse_json({sql})")


def records(df: DataFrame, source: str, ordinal: Column, **fields: Column) -> DataFrame:
    body = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return df.select(F.lit(source).alias("source_id"), ordinal.cast("bigint").alias("ordinal"), body.alias("text"))


def app_logs(spark: SparkSession, sf: str) -> DataFrame:
    """One structured application log line per row of `events`."""
    ev = deal_rows(table(spark, sf, "events")).withColumn("iso", F.date_format("ts", ISO))
    return records(
        ev, "app-log", F.col("event_id"),
        timestamp=js("""CASE event_id % 13 WHEN 0 THEN cast(unix_millis(cast(ts AS timestamp)) AS string)
                     WHEN 1 THEN NULL WHEN 2 THEN '"not a time"' ELSE '"' || iso || '"' END"""),
        level=js("""CASE event_type WHEN 'error' THEN '"error"' WHEN 'click' THEN '30' WHEN 'purchase' THEN '"WARN"'
                 WHEN 'view' THEN '"debug"' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN '"Unknown"' END END"""),
        message=F.expr("CASE WHEN event_id % 17 != 0 THEN event_type || ' by user ' || user_id END"),
        service=F.expr("CASE WHEN event_id % 11 != 0 THEN 'svc-' || (user_id % 8) END"),
        logger=F.expr("'app.' || event_type"),
        requestId=F.expr("'req-' || user_id"),
        traceId=F.expr("CASE WHEN event_id % 3 = 0 THEN 'projects/p/traces/t' || (event_id div 10) END"),
        spanId=F.expr("CASE WHEN event_id % 3 = 0 THEN 's' || event_id END"),
        type=F.col("event_type"),
        value=F.col("value"),
        props=F.try_parse_json("props"),
        mixed=js("""CASE event_id % 7 WHEN 0 THEN (event_id % 50) || CASE event_id % 21 WHEN 7 THEN '.5' WHEN 14 THEN '.0' ELSE '' END
                 WHEN 1 THEN '"s' || user_id || '"' WHEN 2 THEN CASE WHEN event_id % 4 < 2 THEN 'true' ELSE 'false' END
                 WHEN 3 THEN 'null' WHEN 4 THEN '[' || (event_id % 5) || ',2]' WHEN 5 THEN '{"k":' || (event_id % 3) || '}' END"""),
        **{"odd key": F.expr("event_id % 4")},
    )


# The same rows for the check SQL, from the table's own columns.
LOGS = """logs AS (
  SELECT event_id AS ordinal, user_id, event_type, value, ts,
    CASE event_id % 13 WHEN 0 THEN CAST((epoch_us(ts) // 1000) AS VARCHAR) WHEN 1 THEN NULL WHEN 2 THEN 'not a time'
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END AS timestamp_raw,
    CASE WHEN event_id % 13 NOT IN (1, 2) THEN (epoch_us(ts) // 1000) END AS ms,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'info' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'debug'
      WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'Unknown' END END AS severity,
    CASE WHEN event_id % 17 <> 0 THEN event_type || ' by user ' || user_id END AS message,
    CASE WHEN event_id % 11 <> 0 THEN 'svc-' || (user_id % 8) END AS service,
    'app.' || event_type AS logger, 'req-' || user_id AS request_id,
    CASE WHEN event_id % 3 = 0 THEN 't' || (event_id // 10) END AS trace_id,
    CASE WHEN event_id % 3 = 0 THEN 's' || event_id END AS span_id,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    CASE event_id % 7 WHEN 0 THEN CASE WHEN event_id % 21 = 7 THEN 'number' ELSE 'integer' END WHEN 1 THEN 'string' WHEN 2 THEN 'boolean'
      WHEN 3 THEN 'null' WHEN 4 THEN 'array' WHEN 5 THEN 'object' END AS mixed_kind,
    CASE WHEN event_id % 7 = 0 THEN event_id % 50 + CASE WHEN event_id % 21 = 7 THEN 0.5 ELSE 0 END END AS mixed_num,
    CASE WHEN event_id % 7 = 1 THEN 's' || user_id END AS mixed_str,
    CASE WHEN event_id % 7 = 2 THEN event_id % 4 < 2 END AS mixed_bool,
    CASE event_id % 7 WHEN 0 THEN CASE WHEN event_id % 21 = 7 THEN (event_id % 50) || '.5' ELSE CAST(event_id % 50 AS VARCHAR) END
      WHEN 1 THEN 's' || user_id WHEN 2 THEN CASE WHEN event_id % 4 < 2 THEN 'true' ELSE 'false' END WHEN 3 THEN 'null'
      WHEN 4 THEN '[' || (event_id % 5) || ',2]' WHEN 5 THEN '{"k":' || (event_id % 3) || '}' END AS mixed_text
  FROM events)"""


def log_records(spark: SparkSession, sf: str) -> DataFrame:
    return parse_texts(app_logs(spark, sf))
