"""Progress of running scans, from metrics that Spark observes on the rows as they pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

METRICS = ["records", "bytes", "valid", "blank", "problem_bytes"]
PROGRESS = "batch bigint, " + ", ".join(f"{m} bigint, total_{m} bigint" for m in METRICS)


def _metrics():
    valid, size = F.col("parse_state") == "valid", F.col("content_len")
    return [F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(valid).alias("valid"), F.count_if(F.col("parse_state") == "blank").alias("blank"),
            F.coalesce(F.sum(F.when(~valid, size)), F.lit(0)).alias("problem_bytes")]


def observe_scan(records: DataFrame) -> tuple[DataFrame, Observation]:
    """Classified records that count themselves while another job reads them; the observation waits for the first such job."""
    seen = Observation("scan")
    return records.observe(seen, *_metrics()), seen


def observed_stream(records: DataFrame, name: str = "scan") -> DataFrame:
    """A stream of classified records whose query reports what it has read."""
    return records.observe(name, *_metrics())


def progress(spark: SparkSession, query: StreamingQuery, name: str = "scan") -> DataFrame:
    """A row per batch that the query still remembers (spark.sql.streaming.numRecentProgressUpdates), with running totals.

    May be asked while the query runs. Only the batches' metrics are read, never records.
    """
    totals, rows = dict.fromkeys(METRICS, 0), []
    for p in query.recentProgress:
        seen = p.observedMetrics.get(name)
        if seen is None or not p.numInputRows:
            continue
        row = [p.batchId]
        for m in METRICS:
            value = int(seen[m] or 0)
            totals[m] += value
            row += [value, totals[m]]
        rows.append(tuple(row))
    return spark.createDataFrame(rows, PROGRESS)
