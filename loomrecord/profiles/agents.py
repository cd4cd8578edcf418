"""Agent events under provider-neutral alias names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.functions.times import MAX_DATE_MS
from loomrecord.profiles.base import Profile, actor_from_role, derived, taken

# Alias keys, tried in order on the record and then on its envelopes.
NESTED_KEYS = ["payload", "data", "event", "record", "message", "interaction", "usage", "body", "detail"]
ALIASES = {
    "event": ["event", "event_type", "type", "kind"],
    "role": ["role", "actor", "author"],
    "session": ["session_id", "sessionId", "session", "conversation_id", "conversationId"],
    "turn": ["turn_id", "turnId", "turn"],
    "message": ["message_id", "messageId", "message_uuid", "messageUuid"],
    "parent": ["parent_id", "parentId", "parent_uuid", "parentUuid"],
    "tool": ["tool_call_id", "toolCallId", "call_id", "callId", "tool_use_id", "toolUseId"],
    "subagent": ["subagent_id", "subagentId", "agent_id", "agentId"],
    "model": ["model", "model_name", "modelName"],
    "status": ["status", "state", "finishReason", "finish_reason"],
    "severity": ["severity", "level"],
    "time": ["timestamp", "time", "created_at", "createdAt"],
    "content": ["content", "text", "reasoning", "thinking", "think", "output", "message"],
    "other_text": ["summary", "text", "message", "output", "result", "reason", "description"],
    "usage": ["usage", "token_usage", "tokenUsage"],
    "tool_name": ["tool_name", "toolName", "name", "function_name", "functionName"],
    "tool_error": ["is_error", "isError", "error"],
}
# Event names that are kinds themselves.
DIRECT_KINDS = {
    "session": "session", "turn": "turn", "message": "message", "reasoning": "reasoning", "think": "reasoning",
    "tool_call": "tool_call", "tool_use": "tool_call", "tool_result": "tool_result", "tool_output": "tool_result",
    "subagent": "subagent", "approval": "approval", "usage": "usage", "error": "error", "checkpoint": "checkpoint",
    "result": "result", "observation": "observation", "action": "action", "task": "task",
}
# Words inside other event names, in order of precedence.
WORD_KINDS = [
    (["usage", "token"], "usage"), (["error", "fail", "abort"], "error"),
    (["tool%result", "tool%output", "result%tool", "output%tool"], "tool_result"),
    (["tool", "function_call", "interaction"], "tool_call"), (["reason", "think"], "reasoning"), (["message", "prompt"], "message"),
    (["subagent", "delegate"], "subagent"), (["session"], "session"), (["turn", "step"], "turn"), (["checkpoint", "compact"], "checkpoint"),
    (["result"], "result"), (["observe"], "observation"), (["action"], "action"), (["task"], "task"),
]


# The fields that are read of a record and of each envelope, in one pass over it.
KEYS = list(dict.fromkeys([*NESTED_KEYS, *[k for keys in ALIASES.values() for k in keys]]))


def with_envelopes(records: DataFrame) -> DataFrame:
    """`_top`: fields of the record; `_below`: those of the objects below its envelope keys, two levels deep, in document order."""
    shape = "struct<" + ",".join(f"`{k}`:variant" for k in KEYS) + ">"

    def nested(m: str) -> str:
        return "array_compact(array(" + ", ".join(f"try_variant_get({m}.`{k}`, '$', '{shape}')" for k in NESTED_KEYS) + "))"

    df = J.fence(records, _top=J.fields(F.col("value"), *KEYS))
    return J.fence(df, _below=F.expr(f"flatten(transform({nested('_top')}, c -> concat(array(c), {nested('c')})))"))


def _first(keys: list[str]) -> Column:
    """The first alias of the record that is present and not null, else that of its envelopes."""
    each = J.coalesce_sql(*[f"if(is_variant_null(c.`{k}`), null, c.`{k}`)" for k in keys])
    return F.coalesce(taken(lambda k: "_top", *[(k,) for k in keys]), F.expr(f"get(filter(transform(_below, c -> {each}), x -> x IS NOT NULL), 0)"))


def locate(name: str) -> Column:
    return _first(ALIASES[name])


def event_kind(name: Column, nested_type: Column) -> Column:
    """Exact names first, then words inside the name, then the type of the record."""
    flat = F.regexp_replace(F.lower(name), r"[.\s-]+", "_")
    words = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"n.a LIKE '%{w}%'".replace("_", "\\\\_") if "_" in w else f"n.a LIKE '%{w}%'" for w in ws) + f" THEN '{k}'" for ws, k in WORD_KINDS[:7]
    ) + " WHEN n.a LIKE '%session%' OR n.a = 'metadata' THEN 'session' " + " ".join(
        "WHEN " + " OR ".join(f"n.a LIKE '%{w}%'" for w in ws) + f" THEN '{k}'" for ws, k in WORD_KINDS[8:]
    ) + " END"
    table = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in DIRECT_KINDS.items()) + ")"
    nested = F.regexp_replace(F.lower(nested_type), r"[.\s-]+", "_")
    body = f"coalesce({table}[n.a], {words}, {table}[n.b], 'other')"
    return J.let_sql(F.struct(flat.alias("a"), nested.alias("b")), body, "n")


# Block types that count as thinking, and media shown as a reference.
THINKING = ["thinking", "think", "reasoning"]
MEDIA = ["image", "image_url", "audio", "audio_url", "video", "video_url"]


def content_text(value: Column) -> Column:
    """Text of a string, of up to 16 blocks, or of an object with text, content or output; 240 characters."""
    kind = f"lower(coalesce({J.scalar_sql(J.get_sql('b', 'type'))}, {J.scalar_sql(J.get_sql('b', 'kind'))}))"
    texts = ", ".join(J.scalar_sql(J.get_sql("b", k)) for k in ("text", "thinking", "think", "content"))
    media = ", ".join(f"'{m}'" for m in MEDIA)
    block = (
        f"if(schema_of_variant(b) = 'STRING', try_variant_get(b, '$', 'string'), coalesce({texts}, "
        f"if({kind} IN ({media}), concat('[', {kind}, ' reference]'), concat('[', {kind}, ']'))))"
    )
    items = "try_variant_get(v, '$', 'array<variant>')"
    parts = f"filter(transform(slice({items}, 1, 16), b -> {block}), t -> t IS NOT NULL)"
    obj = J.coalesce_sql(*[J.scalar_sql(J.get_sql("v", k)) for k in ("text", "content", "output")])
    body = (
        f"trim(substring(CASE WHEN schema_of_variant(v) = 'STRING' THEN try_variant_get(v, '$', 'string') "
        f"WHEN {items} IS NOT NULL THEN array_join({parts}, ' ') WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN {obj} END, 1, 240))"
    )
    return J.let_sql(value, body)


def _time_text(value: Column) -> Column:
    n = "try_variant_get(v, '$', 'double')"
    ms = f"if(abs({n}) < 1e12, {n} * 1000, {n})"
    iso = f"if(abs({ms}) <= {MAX_DATE_MS}, date_format(timestamp_millis(cast({ms} AS bigint)), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), null)"
    return J.let_sql(value, f"CASE WHEN schema_of_variant(v) = 'STRING' THEN nullif(try_variant_get(v, '$', 'string'), '') "
                            f"WHEN schema_of_variant(v) rlike '^(BIGINT|DOUBLE|DECIMAL)' THEN {iso} END")


def _screen(records: DataFrame) -> DataFrame:
    """What detection asks for, and only of records with a known kind."""
    df = J.fence(with_envelopes(records), _event_v=locate("event"), _type_v=_first(["type", "kind"]))
    df = J.fence(df, _event=F.expr(J.scalar_sql("_event_v")), _type=F.expr(J.scalar_sql("_type_v")))
    df = J.fence(df, _kind=F.when(F.col("_event").isNotNull(), event_kind(F.col("_event"), F.col("_type"))))
    known = F.col("_kind") != "other"
    signal = F.coalesce(*[locate(n) for n in ("role", "content", "tool", "usage", "status", "severity")]).isNotNull()
    df = J.fence(df, _recognized=F.coalesce(F.when(known, signal), F.lit(False)))
    ids = ("session", "turn", "message", "parent", "tool", "subagent")
    df = J.fence(df, **{f"_{n}_v": F.when(F.col("_recognized"), locate(n)) for n in ids})
    return J.fence(df, _identified=F.coalesce(*[F.expr(J.scalar_sql(f"_{n}_v")) for n in ids]).isNotNull())


def _prepare(records: DataFrame) -> DataFrame:
    df = J.fence(with_envelopes(records), **{f"_{n}_v": locate(n) for n in ALIASES})
    ids = ("event", "role", "session", "turn", "message", "parent", "tool", "subagent", "model", "status", "severity", "tool_name")
    texts = {f"_{n}": J.let_sql(F.col(f"_{n}_v"), J.scalar_sql("v")) for n in ids}
    direct = J.let_sql(F.struct(F.col("_usage_v").alias("u"), F.col("value").alias("r")),
                       f"coalesce({J.usage_generic_sql('q.u')}, null)", "q")
    type_text = J.let_sql(_first(["type", "kind"]), J.scalar_sql("v"))
    df = J.fence(df, **texts, _usage=direct, _content=F.nullif(content_text(F.col("_content_v")), F.lit("")))
    return J.fence(df, _kind=event_kind(F.col("_event"), type_text))


def _columns() -> dict[str, Column]:
    own_usage = F.when(F.col("_kind") == "usage", J.let_sql(F.col("value"), J.usage_generic_sql("v")))
    summary = F.coalesce(F.col("_content").cast("variant"), F.col("_other_text_v"), F.col("_event").cast("variant"), F.col("value"))
    return {
        "event_kind": F.col("_kind"), "timestamp_raw": _time_text(F.col("_time_v")), "actor": actor_from_role(F.col("_role")),
        "session_id": F.col("_session"), "turn_id": F.col("_turn"), "parent_id": F.col("_parent"), "message_id": F.col("_message"),
        "tool_call_id": F.col("_tool"), "subagent_id": F.col("_subagent"), "model": F.col("_model"), "status": F.col("_status"),
        "severity": F.col("_severity"), "summary": J.bounded_summary(summary, F.coalesce("_event", F.lit("Agent event"))),
        "usage": F.coalesce("_usage", own_usage), "confidence": F.when(F.col("_event_v").isNotNull(), "source").otherwise("inferred"),
        "derived": derived(content=F.col("_content").cast("variant"), toolName=F.col("_tool_name").cast("variant"),
                           toolError=F.when(J.is_boolean(F.col("_tool_error_v")), F.col("_tool_error_v"))),
    }


def _path(name: str) -> Column:
    """The path of an alias on the record itself; values from envelopes show the envelope key."""
    cases = []
    for prefix in [(), *[(k,) for k in NESTED_KEYS]]:
        for k in ALIASES[name]:
            g = J.get_sql("value", *prefix, k)
            cases.append(f"WHEN {g} IS NOT NULL AND NOT is_variant_null({g}) THEN {J.sql_text(J.display_literal(*prefix, k))}")
    return F.expr("CASE " + " ".join(cases) + " END")


def _evidence() -> dict[str, Column]:
    return {
        "event_kind": _path("event"), "actor": _path("role"), "session_id": _path("session"), "turn_id": _path("turn"),
        "message_id": _path("message"), "parent_id": _path("parent"), "tool_call_id": _path("tool"), "subagent_id": _path("subagent"),
    }


def _signals() -> dict[str, Column]:
    return {"recognized": F.col("_recognized"), "identified": F.col("_identified")}


def _score(s, n):
    score = F.least(F.lit(0.86), 0.48 * s["recognized"] / n + 0.38 * s["identified"] / n)
    return score, s["identified"] > 0


AGENT_EVENTS = Profile("generic-agent-events", "1", _columns, _signals, _score, _prepare, _evidence, screen=_screen)
