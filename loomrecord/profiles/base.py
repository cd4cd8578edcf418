"""Shared parts of the normalisers: records in, one `events` row per record out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.functions.times import text_to_ms

EVENT_COLUMNS = {
    "event_kind": "string", "timestamp_raw": "string", "actor": "string", "session_id": "string", "turn_id": "string",
    "parent_id": "string", "message_id": "string", "tool_call_id": "string", "subagent_id": "string", "model": "string",
    "status": "string", "severity": "string", "summary": "string",
    "usage": "struct<input:double,output:double,cached:double,total:double>",
    "derived": "map<string,variant>", "confidence": "string",
}
# Speaker names an event keeps; any other name becomes unknown.
ACTORS = ["user", "assistant", "tool", "system", "developer", "agent"]


def actor_from_role(role: Column) -> Column:
    low = F.lower(role)
    return F.when(role.isNull() | (role == ""), None).when(low.isin(ACTORS), low).otherwise("unknown")


def taken(path, *paths: tuple) -> Column:
    """The first alias that is present and not null, over structs made by `J.fields`; `path` names the struct that holds a key."""
    def one(first, *rest) -> str:
        top = f"{path(first)}.`{first}`"
        return J.nonnull_sql(top, *rest) if rest else f"if(is_variant_null({top}), null, {top})"
    return F.expr(J.coalesce_sql(*[one(*p) for p in paths]))


def located_path(value: str, *paths: tuple) -> Column:
    """Display path of the alias that `taken` finds."""
    cases = [(J.get_sql(value, *p), J.sql_text(J.display_literal(*p))) for p in paths]
    return F.expr("CASE " + " ".join(f"WHEN {g} IS NOT NULL AND NOT is_variant_null({g}) THEN {d}" for g, d in cases) + " END")


def derived(**fields: Column) -> Column:
    """MAP<STRING,VARIANT> of the fields that are present; strings are bounded one-liners."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in fields.items()])
    return F.map_from_entries(F.call_function("filter", entries, F.expr("e -> e.value IS NOT NULL")))


@dataclass(frozen=True)
class Profile:
    """A record family: signal columns that detect it and columns that normalise it.

    `prepare` may add helper columns, and `screen` only those that detection asks for; `columns` gives Columns for any of
    EVENT_COLUMNS over the prepared frame. Absent ones become NULL. `varied` gives
    text columns; `score` is told of each whether a source has two or more values.
    """

    id: str
    version: str
    columns: object
    signals: object = None
    score: object = None
    prepare: object = field(default=lambda df: df)
    evidence: object = None
    varied: object = dict
    screen: object = None

    def project(self, records: DataFrame, keep: tuple[str, ...] = ("source_id", "ordinal"), evidence: bool = False) -> DataFrame:
        """The events of a set of parsed records; records without a value become `other`.

        With `evidence`, also the paths each field was read from.
        """
        df = self.prepare(records)
        cols = self.columns()
        out = [F.lit(self.id).alias("profile_id"), F.lit(self.version).alias("profile_version")]
        for name, typ in EVENT_COLUMNS.items():
            out.append(cols.get(name, F.lit(None)).cast(typ).alias(name))
        paths = self.evidence() if evidence and self.evidence else {}
        found = [
            F.when(cols[f].isNotNull() if f in cols else F.lit(True), F.struct(F.lit(f).alias("field"), p.alias("path")))
            for f, p in paths.items()
        ]
        kind = "array<struct<field:string,path:string>>"
        if evidence:
            rows = F.filter(F.array(*found), lambda e: e.isNotNull() & e["path"].isNotNull()) if found else F.expr("array()")
            out.append(rows.cast(kind).alias("evidence"))
        events = df.select(*keep, *out)
        events = events.withColumn("event_kind", F.coalesce("event_kind", F.lit("other")))
        ms = text_to_ms(F.col("timestamp_raw"))
        return events.withColumn("ts", F.timestamp_millis(ms.cast("bigint")))
