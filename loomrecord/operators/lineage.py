"""Lineage: references between records that the records themselves prove.

An id takes part only if it was read, with source confidence, from the exact path that
the record family writes it to. Events need `evidence` and `confidence` columns, and a
`generation` where a source has several; ids never meet across sources, generations or
profiles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.session import materialize

PLACE = ["source_id", "generation", "profile_id"]
RECORD = ["source_id", "generation", "ordinal"]

# Profiles, and the paths at which each writes the ids that prove a relation.
PARENT_PATHS = {"claude-code-session": ["$.parentUuid"], "pi-coding-agent": ["$.parentId"]}
IDENTITY_PATHS = {"claude-code-session": ["$.uuid"], "pi-coding-agent": ["$.id"]}
SPAN_PROFILE = "opentelemetry"
SPAN_PATHS = ["$.spanId", "$.SpanId"]
SPAN_PARENT_PATHS = ["$.parentSpanId", "$.ParentSpanId"]
TRACE_PATHS = ["$.traceId", "$.TraceId"]
TOOL_PROFILE = "codex-rollout"
TOOL_PATHS = ["$.payload.call_id"]
# Reasons for missing relations.
AMBIGUOUS = ["ambiguous-record-ref", "ambiguous-parent", "ambiguous-tool-pair"]


def proved(field: str, paths: list[str]) -> Column:
    return (F.col("confidence") == "source") & F.exists("evidence", lambda e: (e["field"] == field) & e["path"].isin(paths))


def present(text: str) -> Column:
    """Not null and more than white space."""
    return F.coalesce(F.col(text).rlike(r"[^\s\p{Z}\x{FEFF}]"), F.lit(False))


def _by_profile(field: str, paths: dict[str, list[str]]) -> Column:
    return reduce(lambda a, b: a | b, [(F.col("profile_id") == p) & proved(field, at) for p, at in paths.items()])


def lineage_keys(events: DataFrame) -> DataFrame:
    """Per record, the proved ids and their keys.

    A key is the JSON array of source, generation, profile, session, turn and id, so its
    parts cannot run together. Spans leave out the turn, need a proved trace id, and ids
    of zeros only are no ids. Tool keys need session and turn. Records whose place
    (source, generation, ordinal) occurs more than once are marked `repeated` and have
    no keys.
    """
    if "generation" not in events.columns:
        events = events.withColumn("generation", F.lit(""))
    e = events.withColumn("generation", F.col("generation").cast("string"))
    span = F.col("profile_id") == SPAN_PROFILE
    zeros = lambda c: F.col(c).rlike("^0*$")
    of_span, of_log = span & (F.col("event_kind") == "span"), span & (F.col("event_kind") == "log")
    e = e.withColumns({
        "parent_proved": F.coalesce(_by_profile("parent_id", PARENT_PATHS) | (of_span & ~zeros("parent_id") & proved("parent_id", SPAN_PARENT_PATHS)), F.lit(False)),
        "context_proved": F.coalesce(of_log & ~zeros("parent_id") & proved("parent_id", SPAN_PATHS), F.lit(False)),
        "identity_proved": F.coalesce(_by_profile("message_id", IDENTITY_PATHS) | (of_span & proved("message_id", SPAN_PATHS)), F.lit(False)),
        "tool_proved": F.coalesce((F.col("profile_id") == TOOL_PROFILE) & proved("tool_call_id", TOOL_PATHS), F.lit(False)),
        "trace_proved": F.coalesce(proved("session_id", TRACE_PATHS), F.lit(False)),
        "has_turn": present("turn_id"), "has_session": present("session_id"),
        "no_parent": span & F.coalesce(zeros("parent_id"), F.lit(False)),
    })

    def key(name: str) -> Column:
        base = [F.col(c) for c in PLACE]
        plain = F.to_json(F.array(*base, "session_id", F.when(F.col("has_turn"), F.col("turn_id")), name))
        traced = F.when(F.col("trace_proved") & ~F.col(name).rlike("^0+$") & ~F.col("session_id").rlike("^0+$"), F.to_json(F.array(*base, "session_id", name)))
        return F.when(F.col("has_session") & present(name), F.when(span, traced).otherwise(plain))
    tools = F.col("event_kind").isin("tool_call", "tool_result") & (F.col("profile_id") == TOOL_PROFILE) & F.col("tool_call_id").isNotNull()
    flags = ["parent_proved", "context_proved", "identity_proved", "tool_proved", "trace_proved", "has_turn", "has_session", "no_parent"]
    ids = ["event_kind", "session_id", "turn_id", "parent_id", "message_id", "tool_call_id"]
    # Written narrow: both sides of the join below read it, not the records behind it.
    e = materialize(e.select(*PLACE, "ordinal", *ids, *flags), "proved")
    repeated = e.groupBy(*RECORD).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*RECORD, F.lit(True).alias("repeated"))
    e = e.join(repeated, RECORD, "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    alone = ~F.col("repeated")
    refers = F.col("parent_id").isNotNull() & (F.col("parent_proved") | F.col("context_proved")) & alone
    owns = F.col("message_id").isNotNull() & F.col("identity_proved") & alone
    return e.select(
        *PLACE, "ordinal", "event_kind", "repeated", "session_id", "has_session", "has_turn",
        F.when(owns, F.col("message_id")).alias("own_id"), F.when(owns, key("message_id")).alias("own_key"),
        F.when(refers, F.col("parent_id")).alias("parent_id"), F.when(refers, key("parent_id")).alias("parent_key"),
        F.when(F.col("context_proved"), "span-context").otherwise("parent").alias("relation"),
        (tools & F.col("tool_proved") & alone).alias("tool"),
        F.when(tools & F.col("tool_proved") & alone & F.col("has_turn"), key("tool_call_id")).alias("tool_key"),
        (alone & F.col("parent_id").isNotNull() & ~F.col("parent_proved") & ~F.col("context_proved") & ~F.col("no_parent")).alias("unverified_parent"),
        (alone & tools & ~F.col("tool_proved")).alias("unverified_tool"))


def _parents(keys: DataFrame) -> DataFrame:
    """Each proved reference with the number of its owners, the one owner, and why there is none.

    Owners are counted per key before the join, so an id that many records write or
    refer to is one row on the owners' side.
    """
    own = keys.where(F.col("own_id").isNotNull())
    owners = own.where(F.col("own_key").isNotNull()).groupBy(F.col("own_key").alias("parent_key")).agg(F.count(F.lit(1)).alias("owners"), F.min("ordinal").alias("owner"))
    # The same id elsewhere: without a session, or in the same session with and without a turn.
    anywhere = own.groupBy(*PLACE, F.col("own_id").alias("parent_id")).agg(F.bool_or(~F.col("has_session")).alias("sessionless"))
    in_session = own.where("has_session").groupBy(*PLACE, F.col("own_id").alias("parent_id"), "session_id").agg(F.bool_or("has_turn").alias("with_turn"), F.bool_or(~F.col("has_turn")).alias("turnless"))
    # Rows without a key get one of their own, so that they do not meet in one task.
    own_place = lambda c: F.coalesce(c, F.concat(F.lit(" "), F.col("ordinal")))
    refs = keys.where(F.col("parent_id").isNotNull()).withColumn("at_key", own_place("parent_key")).join(owners.withColumnRenamed("parent_key", "at_key"), "at_key", "left").join(anywhere, [*PLACE, "parent_id"], "left").join(in_session, [*PLACE, "parent_id", "session_id"], "left")
    partial = F.coalesce("sessionless", F.lit(False)) | F.coalesce(F.when(F.col("has_turn"), F.col("turnless")).otherwise(F.col("with_turn")), F.lit(False))
    status = F.when(F.col("parent_key").isNull(), "missing-context").when(F.col("owners") == 1, "matched").when(F.col("owners") > 1, "ambiguous").when(partial, "missing-context").otherwise("unmatched")
    return refs.select(*PLACE, "relation", "ordinal", "parent_key", status.alias("status"), F.when(status == "matched", F.col("owner")).alias("partner"))


def lineage_pairs(keys: DataFrame) -> DataFrame:
    """A call and a result pair only when each is the single one of its key."""
    k = keys.where("tool")
    call, result = F.col("event_kind") == "tool_call", F.col("event_kind") == "tool_result"
    per_key = k.where(F.col("tool_key").isNotNull()).groupBy("tool_key").agg(
        F.count_if(call).alias("calls"), F.count_if(result).alias("results"), F.min(F.when(call, F.col("ordinal"))).alias("call"), F.min(F.when(result, F.col("ordinal"))).alias("result"))
    out = k.withColumn("at_key", F.coalesce("tool_key", F.concat(F.lit(" "), F.col("ordinal")))).join(per_key.withColumnRenamed("tool_key", "at_key"), "at_key", "left")
    status = F.when(F.col("tool_key").isNull(), "missing-context").when((F.col("calls") == 1) & (F.col("results") == 1), "matched").when(
        (F.col("calls") == 0) | (F.col("results") == 0), "unmatched").otherwise("ambiguous")
    partner = F.when(call, F.col("result")).otherwise(F.col("call"))
    return out.select(*PLACE, F.lit("tool-pair").alias("relation"), "ordinal", "event_kind", status.alias("status"), F.when(status == "matched", partner).alias("partner"))


def lineage(events: DataFrame) -> DataFrame:
    """Every proved reference with its status and, if unique, its partner."""
    keys = materialize(lineage_keys(events), "keys")  # read many times, and narrow
    return _parents(keys).drop("parent_key").unionByName(lineage_pairs(keys).drop("event_kind"))


def lineage_issues(events: DataFrame) -> DataFrame:
    """(place, ordinal, reason), once each: why relations of a record are missing.

    Of an ambiguous parent, the parents are marked like the child.
    """
    keys = materialize(lineage_keys(events), "keys")  # read many times, and narrow
    refs, pairs = _parents(keys), lineage_pairs(keys)
    at = [*PLACE, "ordinal"]
    named = lambda df, kind: df.where("status <> 'matched'").select(*at, F.when(F.col("status") == "missing-context", f"missing-{kind.split('-')[0]}-context").otherwise(F.concat("status", F.lit(f"-{kind}"))).alias("reason"))
    doubtful = refs.where("status = 'ambiguous'").select(F.col("parent_key").alias("own_key")).distinct()
    parents = keys.join(doubtful, "own_key", "left_semi").select(*at, F.lit("ambiguous-parent").alias("reason"))
    marked = [keys.where(c).select(*at, F.lit(r).alias("reason")) for c, r in (("unverified_parent", "unverified-parent-evidence"), ("unverified_tool", "unverified-tool-evidence"), ("repeated", "ambiguous-record-ref"))]
    return reduce(DataFrame.unionByName, [named(refs, "parent"), named(pairs, "tool-pair"), parents, *marked]).distinct()


def lineage_coverage(events: DataFrame) -> DataFrame:
    """Records per reason, and whether the reason leaves a choice open."""
    return lineage_issues(events).groupBy("reason").agg(F.count(F.lit(1)).alias("records")).withColumn("ambiguous", F.col("reason").isin(AMBIGUOUS))


def lineage_edges(events: DataFrame) -> DataFrame:
    """Matched relations as (place, kind, src, dst): parent to child, span to log, call to result."""
    keys = materialize(lineage_keys(events), "keys")  # read many times, and narrow
    up = _parents(keys).where("status = 'matched'").select(*PLACE, F.col("relation").alias("kind"), F.col("partner").alias("src"), F.col("ordinal").alias("dst"))
    calls = lineage_pairs(keys).where("status = 'matched' AND event_kind = 'tool_call'")
    return up.unionByName(calls.select(*PLACE, F.lit("responds").alias("kind"), F.col("ordinal").alias("src"), F.col("partner").alias("dst")))


def neighbourhood(edges: DataFrame, start: int, depth: int = 3, max_nodes: int | None = 15) -> tuple[DataFrame, list[str]]:
    """((node, distance, direction) around one record, reasons why there may be more).

    A node is an ancestor or descendant while all steps to it go the same way over
    `parent` edges, else related; of several shortest ways, the one by the smallest
    nodes counts. Nearest nodes come first, then by ordinal. Only nodes near the start
    are kept; the edges are written once and read in every round.
    """
    both = edges.select(F.explode(F.array(
        F.struct("src", "dst", F.when(F.col("kind") == "parent", "descendant").otherwise("related").alias("way")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.when(F.col("kind") == "parent", "ancestor").otherwise("related").alias("way")))).alias("e")).select("e.*").where("src <> dst").distinct()
    both = materialize(both, "edges")
    seen = edges.sparkSession.createDataFrame([(start, 0, "selected")], "node bigint, distance int, direction string")
    frontier, reasons = seen, []
    for d in range(1, depth + 2):
        step = frontier.select(F.col("node").alias("src"), "direction").join(both, "src")
        way = F.when((F.col("direction") == "selected") | (F.col("direction") == F.col("way")), F.col("way")).otherwise("related")
        fresh = step.join(seen.select(F.col("node").alias("dst")), "dst", "left_anti").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("src", way.alias("way"))).alias("by"))
        frontier = materialize(fresh.select("node", F.lit(d).alias("distance"), F.col("by.way").alias("direction")), "frontier")
        if d > depth:
            reasons += ["depth-limit"] if not frontier.isEmpty() else []
        else:
            seen = seen.unionByName(frontier)
    if max_nodes is None:
        return seen, reasons
    if seen.count() > max_nodes:
        reasons.append("node-limit")
    return seen.orderBy("distance", "node").limit(max_nodes), reasons


def lookup_window(events: DataFrame, window: int = 500) -> DataFrame:
    """Parent or span context in the `window` records before, partner after a call or before a result.

    A range join on key equality and ordinal distance, reduced per reference by a
    count, so that an id repeated many times never emits its pairs downstream. The
    ordinal is cut into windows so that one id's rows spread over many tasks.
    """
    keys = materialize(lineage_keys(events), "keys")  # read many times, and narrow
    place = ["source_id", "generation"]
    owners = keys.where(F.col("own_key").isNotNull()).select(F.col("own_key").alias("k"), F.col("ordinal").alias("at"), F.lit("owner").alias("seeks"))
    tools = keys.where(F.col("tool_key").isNotNull()).select(F.col("tool_key").alias("k"), F.col("ordinal").alias("at"), F.col("event_kind").alias("seeks"))
    targets = owners.unionByName(tools).withColumn("cell", F.floor(F.col("at") / window))
    # A target that its owners write more than once in a cell stays several rows: that is what makes it ambiguous.
    p = keys.where(F.col("parent_key").isNotNull()).select(*place, F.col("parent_key").alias("k"), "ordinal", "relation", F.lit("owner").alias("seeks"),
                                                           (F.col("ordinal") - window).alias("lo"), (F.col("ordinal") - 1).alias("hi"))
    call = F.col("event_kind") == "tool_call"
    t = keys.where(F.col("tool_key").isNotNull()).select(
        *place, F.col("tool_key").alias("k"), "ordinal", F.lit("tool-partner").alias("relation"), F.when(call, "tool_result").otherwise("tool_call").alias("seeks"),
        F.when(call, F.col("ordinal") + 1).otherwise(F.col("ordinal") - window).alias("lo"), F.when(call, F.col("ordinal") + window).otherwise(F.col("ordinal") - 1).alias("hi"))
    refs = p.unionByName(t).withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / window), F.floor(F.col("hi") / window))))
    inside = F.col("at").between(F.col("lo"), F.col("hi"))
    hits = refs.join(targets, ["k", "seeks", "cell"], "left").groupBy(*place, "ordinal", "relation").agg(F.count_if(inside).alias("hits"), F.min(F.when(inside, F.col("at"))).alias("at"))
    status = F.when(F.col("hits") == 0, "not-observed").when(F.col("hits") == 1, "found").otherwise("ambiguous")
    return hits.select(*place, "ordinal", "relation", status.alias("status"), F.when(F.col("hits") == 1, F.col("at")).alias("partner"))


def document_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node per record, and edges `parent` (parent to child) and `responds` (result to call).

    Only transcripts prove parents here, spans do not. Sessions and turns must be the
    same, and may be absent on both sides alike. Ids must be unique in that context.
    """
    if "generation" not in events.columns:
        events = events.withColumn("generation", F.lit(""))
    kinds = F.when(F.col("event_kind").isin("session", "subagent"), F.col("event_kind")).when(F.col("event_kind").isin("tool_call", "tool_result"), "tool").otherwise("event")
    nodes = events.select("source_id", "generation", F.col("ordinal").alias("node"), kinds.alias("kind"), F.col("event_kind").alias("raw_kind"), F.col("summary").alias("label"))
    context = lambda name: F.to_json(F.array(*PLACE, "session_id", "turn_id", name))
    e = events.select(*PLACE, "ordinal", "event_kind", "confidence", "evidence", "session_id", "turn_id", "message_id", "parent_id", "tool_call_id")
    e = materialize(e, "graph")
    owners = e.where(F.col("message_id").isNotNull() & _by_profile("message_id", IDENTITY_PATHS)).groupBy(context("message_id").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("owner")).where("n = 1")
    children = e.where(F.col("parent_id").isNotNull() & _by_profile("parent_id", PARENT_PATHS)).select(*PLACE, "ordinal", context("parent_id").alias("k"))
    up = children.join(owners, "k").select(*PLACE, F.lit("parent").alias("kind"), F.col("owner").alias("src"), F.col("ordinal").alias("dst"))
    tools = e.where(F.col("tool_call_id").isNotNull() & F.col("event_kind").isin("tool_call", "tool_result")).withColumns({
        "k": context("tool_call_id"), "good": F.coalesce((F.col("profile_id") == TOOL_PROFILE) & proved("tool_call_id", TOOL_PATHS), F.lit(False))})
    called, answered = F.col("good") & (F.col("event_kind") == "tool_call"), F.col("event_kind") == "tool_result"
    pairs = tools.groupBy(*PLACE, "k").agg(F.count_if(called).alias("calls"), F.count_if(answered).alias("results"), F.min(F.when(called, F.col("ordinal"))).alias("call"),
                                           F.min(F.when(answered & F.col("good"), F.col("ordinal"))).alias("result")).where("calls = 1 AND results = 1 AND result IS NOT NULL")
    return nodes, up.unionByName(pairs.select(*PLACE, F.lit("responds").alias("kind"), F.col("result").alias("src"), F.col("call").alias("dst")))
