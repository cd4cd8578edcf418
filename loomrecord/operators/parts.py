"""P5: parts of a row that are made only when asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecord.operators import dataset as D
from loomrecord.operators import otel as O
from loomrecord.operators.conversation import conversation_walk


def default_parts(profile: str | None = None) -> dict[str, bool]:
    """What is made of a row when nothing is asked for."""
    return {"conversation": True, "dataset": profile in (None, "generic")}


def covers(made: dict[str, bool], wanted: dict[str, bool]) -> bool:
    """Whether rows with some parts can answer for others."""
    return all(made.get(part, False) or not asked for part, asked in wanted.items())


def with_parts(rows: DataFrame, conversation: bool = False, dataset: bool = False, profile: str | None = None, key: tuple[str, ...] = ("source_id", "ordinal")) -> DataFrame:
    """Rows of parsed records with the parts asked for; a part that does not fit a row is NULL.

    `conversation` is made within the row. `dataset` adds the training-data observation
    of every record and `calls` for function-calling rows, which wins over `telemetry` (made for
    telemetry rows only). These are summaries of their own, joined by key: rows should be
    a page or a selection. What is not asked for costs nothing.
    """
    def joined(df: DataFrame, summary: DataFrame, name: str) -> DataFrame:
        fields = [c for c in summary.columns if c not in key]
        return df.join(summary.select(*key, F.struct(*fields).alias(name)), list(key), "left")
    out = rows
    if conversation:
        out = out.withColumn("conversation", conversation_walk(F.col("value")))
    if dataset:
        out = joined(out, D.record_summary(rows, key), "dataset")
        out = joined(out, D.call_summary(rows, key), "calls")
    if profile == "opentelemetry":
        out = joined(out, O.record_summary(O.signals(rows, key), key), "telemetry")
        if dataset:
            out = out.withColumn("telemetry", F.when(F.col("calls").isNull(), F.col("telemetry")))
    return out
