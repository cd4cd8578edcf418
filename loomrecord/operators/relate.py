"""Relations between events: groups, parents and tool pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relations never cross sources or profiles: a mixed batch yields none between them.
SCOPE = ["source_id", "profile_id"]
CALLS = ["tool_call", "action"]
RESULTS = ["tool_result", "observation"]
BLOCK = 1 << 16


def members(events: DataFrame, field: str, kind: str) -> DataFrame:
    """An edge from the first record of an id to each later one.

    The anchor is a map-side combined minimum, one row per id; joining it back is
    safe for a hot id, since AQE splits the large side.
    """
    rows = events.filter(F.col(field).isNotNull()).select(*SCOPE, F.col(field).alias("stable_id"), "ordinal")
    anchors = rows.groupBy(*SCOPE, "stable_id").agg(F.min("ordinal").alias("source_key"))
    return rows.join(anchors, [*SCOPE, "stable_id"]).filter(F.col("ordinal") != F.col("source_key")).select(
        *SCOPE, F.lit(kind).alias("kind"), "stable_id", "source_key", F.col("ordinal").alias("target_key"))


def carry(df: DataFrame, keys: list[str], order: str, specs: dict[str, tuple[str, bool]], block: int = BLOCK) -> DataFrame:
    """For {out: (value, forward)}: last (or, backwards, next) non-null value per key at or before each row.

    The order is cut into blocks: windows inside (key, block), windows over a row
    per block, and one join of the two. No key, however hot, is sorted in one task.
    """
    cut = df.withColumn("_b", F.floor(F.col(order) / block))
    edge = [
        (F.max_by if fwd else F.min_by)(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(f"_e_{out}")
        for out, (value, fwd) in specs.items()
    ]
    blocks = cut.groupBy(*keys, "_b").agg(*edge)

    def before(cols: list, position: Column, fwd: bool, upto: int):
        return Window.partitionBy(*cols).orderBy(position if fwd else -position).rowsBetween(Window.unboundedPreceding, upto)

    blocks = blocks.select(*keys, "_b", *[
        F.last(f"_e_{out}", ignorenulls=True).over(before(keys, F.col("_b"), fwd, -1)).alias(f"_c_{out}") for out, (_, fwd) in specs.items()])
    joined = cut.join(blocks, [*keys, "_b"])
    inside = {
        out: F.coalesce(F.last(value, ignorenulls=True).over(before([*keys, "_b"], F.col(order), fwd, 0)), F.col(f"_c_{out}"))
        for out, (value, fwd) in specs.items()
    }
    return joined.withColumns(inside).drop("_b", *[f"_c_{out}" for out in specs])


def parents(events: DataFrame) -> DataFrame:
    """An as-of match of parent ids.

    A child takes the latest message of that id up to and including itself, else
    the latest subagent; otherwise it waits for the first later writer of either.
    Only a child that waited can become a subagent_parent edge.
    """
    e = events.select(*SCOPE, "ordinal", "event_kind", "message_id", "subagent_id", "parent_id")
    uses = F.array(
        F.when(F.col("message_id").isNotNull(), F.struct(F.col("message_id").alias("id"), F.lit("m").alias("use"))),
        F.when(F.col("subagent_id").isNotNull(), F.struct(F.col("subagent_id").alias("id"), F.lit("s").alias("use"))),
        F.when(F.col("parent_id").isNotNull(), F.struct(F.col("parent_id").alias("id"), F.lit("p").alias("use"))),
    )
    rows = e.select(*SCOPE, "ordinal", "event_kind", F.explode(F.filter(uses, lambda u: u.isNotNull())).alias("u")).select(
        *SCOPE, "ordinal", "event_kind", "u.*")
    # One row per (id, record): a record that both writes and refers to an id sees its own write.
    rows = rows.groupBy(*SCOPE, "id", "ordinal").agg(
        F.max(F.when(F.col("use") == "m", F.col("ordinal"))).alias("m"), F.max(F.when(F.col("use") == "s", F.col("ordinal"))).alias("s"),
        F.bool_or(F.col("use") == "p").alias("child"), F.first("event_kind").alias("event_kind"))
    rows = rows.withColumn("w", F.coalesce("m", "s"))
    keys = [*SCOPE, "id"]
    later = F.struct(F.col("w").alias("at"), F.when(F.col("m").isNotNull(), "m").otherwise("s").alias("how"))
    rows = rows.withColumn("_later", F.when(F.col("w").isNotNull(), later))
    rows = carry(rows, keys, "ordinal", {"last_m": ("m", True), "last_s": ("s", True), "next_w": ("_later", False)})
    found = F.coalesce("last_m", "last_s")
    waited = F.when((F.col("next_w.how") == "s") | (F.col("event_kind") == "subagent"), "subagent_parent").otherwise("parent_child")
    out = rows.filter(F.col("child")).select(
        *SCOPE, F.when(found.isNotNull(), "parent_child").otherwise(waited).alias("kind"), F.col("id").alias("stable_id"),
        F.coalesce(found, F.col("next_w.at")).alias("source_key"), F.col("ordinal").alias("target_key"))
    return out.filter(F.col("source_key").isNotNull())


def tool_pairs(events: DataFrame) -> DataFrame:
    """Every call with every result of one tool call id.

    The pairs are the result itself. Kind filters run before the shuffle, and AQE
    splits a hot id.
    """
    e = events.filter(F.col("tool_call_id").isNotNull()).select(*SCOPE, F.col("tool_call_id").alias("stable_id"), "ordinal", "event_kind")
    calls = e.filter(F.col("event_kind").isin(CALLS)).select(*SCOPE, "stable_id", F.col("ordinal").alias("source_key"))
    results = e.filter(F.col("event_kind").isin(RESULTS)).select(*SCOPE, "stable_id", F.col("ordinal").alias("target_key"))
    return calls.join(results, [*SCOPE, "stable_id"]).select(*SCOPE, F.lit("tool_pair").alias("kind"), "stable_id", "source_key", "target_key")


def relations(events: DataFrame) -> DataFrame:
    """All relations of R1-R4; each is unique by kind, id and ends."""
    out = members(events, "session_id", "session_member").unionByName(members(events, "turn_id", "turn_member"))
    return out.unionByName(parents(events)).unionByName(tool_pairs(events))


# Fields whose evidence supports a relation.
RELATION_FIELDS = ["session_id", "turn_id", "message_id", "parent_id", "tool_call_id", "subagent_id"]


def relation_evidence(edges: DataFrame, events: DataFrame, per_end: int = 2) -> DataFrame:
    """Edges without duplicates, with up to two evidence items of each end."""
    wanted = ", ".join(f"'{f}'" for f in RELATION_FIELDS)
    ev = events.select("source_id", "ordinal", F.expr(f"slice(filter(evidence, x -> x.field IN ({wanted})), 1, {per_end})").alias("_e"))
    unique = edges.dropDuplicates([*SCOPE, "kind", "stable_id", "source_key", "target_key"])
    out = unique.join(ev.select("source_id", F.col("ordinal").alias("source_key"), F.col("_e").alias("_a")), ["source_id", "source_key"], "left")
    out = out.join(ev.select("source_id", F.col("ordinal").alias("target_key"), F.col("_e").alias("_z")), ["source_id", "target_key"], "left")
    none = F.expr("cast(array() AS array<struct<field:string,path:string>>)")
    return out.withColumn("evidence", F.concat(F.coalesce("_a", none), F.coalesce("_z", none))).drop("_a", "_z")


def evidence_rows(events: DataFrame) -> DataFrame:
    """One row per (record, field, path)."""
    return events.select("source_id", "ordinal", F.explode("evidence").alias("e")).select("source_id", "ordinal", "e.field", "e.path").dropDuplicates()


def usage_by(events: DataFrame, field: str) -> DataFrame:
    """Token totals per session, turn or model."""
    return events.filter(F.col("usage").isNotNull()).groupBy(F.col(field).alias("key")).agg(
        *[F.sum(f"usage.{p}").alias(p) for p in ("input", "output", "cached", "total")], F.count(F.lit(1)).alias("events"))
