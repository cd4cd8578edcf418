"""Session transcripts of coding agents as events.

Each family is one discriminator table and a few aliased fields. Profile ids and
record type names are fixed values of the file formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.functions.times import is_rfc3339, unix_seconds
from loomrecord.profiles.base import Profile, actor_from_role, derived

V = "value"


def s(*path: str) -> Column:
    return F.expr(J.string_sql(V, *path))


def v(*path: str) -> Column:
    return F.expr(J.get_sql(V, *path))


def either(*paths: tuple) -> Column:
    return F.expr(J.coalesce_sql(*[J.string_sql(V, *p) for p in paths]))


def text_of(value: Column) -> Column:
    """The text of a string or of blocks as a variant; other values stay as they are."""
    return F.coalesce(J.extract_text(value).cast("variant"), value)


def _blocks(path: tuple, kind: str) -> str:
    items = f"try_variant_get({V}, {J.sql_text(J.jsonpath(*path))}, 'array<variant>')"
    return f"get(filter({items}, b -> {J.string_sql('b', 'type')} = '{kind}'), 0)"


# ---- N2: rollout files -----------------------------------------------------------------

# Kinds of the outer record types, of response items and of event messages.
OUTER = {
    "session_meta": "session", "turn_context": "turn", "inter_agent_communication": "subagent", "inter_agent_communication_metadata": "subagent",
    "token_usage_record": "usage", "security_risk_score": "error", "retained_context": "checkpoint", "compacted": "checkpoint", "world_state": "checkpoint",
    "realtime_item": "other",
}
RESPONSE_ITEMS = {
    "message": "message", "reasoning": "reasoning", "web_search_call": "tool_call", "function_call": "tool_call", "custom_tool_call": "tool_call",
    "local_shell_call": "tool_call", "function_call_output": "tool_result", "custom_tool_call_output": "tool_result", "local_shell_call_output": "tool_result",
}
EVENT_MESSAGES = {
    "user_message": "message", "agent_message": "message", "assistant_message": "message", "token_count": "usage", "error": "error", "turn_aborted": "error",
    "approval_request": "approval", "approval_response": "approval", "task_started": "turn", "turn_started": "turn", "task_complete": "result", "turn_complete": "result",
    "agent_reasoning": "reasoning", "agent_reasoning_raw_content": "reasoning", "agent_reasoning_section_break": "reasoning", "reasoning_content_delta": "reasoning",
    "reasoning_raw_content_delta": "reasoning", "thread_settings_applied": "action", "session_configured": "action", "environment_connected": "action",
    "environment_disconnected": "action", "mcp_tool_call_begin": "tool_call", "exec_command_begin": "tool_call", "web_search_begin": "tool_call",
    "image_generation_begin": "tool_call", "view_image_tool_call": "tool_call", "dynamic_tool_call_request": "tool_call", "mcp_tool_call_end": "tool_result",
    "exec_command_end": "tool_result", "web_search_end": "tool_result", "image_generation_end": "tool_result", "dynamic_tool_call_response": "tool_result",
    "patch_apply_begin": "patch", "patch_apply_updated": "patch", "patch_apply_end": "patch", "turn_diff": "patch", "plan_update": "task", "plan_delta": "task",
    "sub_agent_activity": "subagent", "collab_agent_spawn_begin": "subagent", "collab_agent_spawn_end": "subagent", "collab_agent_interaction_begin": "subagent",
    "collab_agent_interaction_end": "subagent", "collab_waiting_begin": "subagent", "collab_waiting_end": "subagent", "collab_close_begin": "subagent",
    "collab_close_end": "subagent", "collab_resume_begin": "subagent", "collab_resume_end": "subagent",
}
LIFECYCLES = ["item_started", "item_updated", "item_completed"]
# Names under which one id is written, in the order in which they are tried.
ITEM_CALL_IDS = ["id", "call_id", "tool_call_id"]
AGENT_IDS = ["agent_thread_id", "agent_id", "task_id", "agent_path"]
ITEM_AGENT_IDS = ["agent_thread_id", "agent_id", "agent_path"]
METADATA_AGENTS = ["agent_id", "child_id", "subagent_id", "recipient"]
COMMUNICATION_AGENTS = ["agent_id", "child_id", "subagent_id", "recipient", "receiver_thread_id"]
METADATA_PARENTS = ["parent_id", "parent_agent_id", "author"]
COMMUNICATION_PARENTS = ["parent_id", "parent_agent_id", "author", "sender_thread_id"]

# Kinds of item types.
ITEM_KINDS = {
    "user_message": "message", "agent_message": "message", "message": "message", "reasoning": "reasoning", "command_execution": "tool_call", "file_change": "patch",
    "function_call": "tool_call", "custom_tool_call": "tool_call", "local_shell_call": "tool_call", "tool_search_call": "tool_call", "mcp_tool_call": "tool_call",
    "dynamic_tool_call": "tool_call", "collab_agent_tool_call": "subagent", "collab_tool_call": "subagent", "sub_agent_activity": "subagent", "plan": "task",
    "todo_list": "task", "hook_prompt": "action", "web_search": "tool_call", "web_search_call": "tool_call", "image_view": "action", "image_generation": "tool_call",
    "image_generation_call": "tool_call", "tool_search_output": "tool_result", "mcp_tool_call_output": "tool_result", "custom_tool_call_output": "tool_result",
    "extension": "tool_call", "entered_review_mode": "action", "exited_review_mode": "action", "context_compaction": "checkpoint", "function_call_output": "tool_result",
    "compaction": "checkpoint", "compaction_summary": "checkpoint", "configuration_update": "action", "compaction_trigger": "action", "error": "error",
}
# Per item type, the statuses and the fields that show that a completed item carries its result.
ITEM_RESULTS = {
    "command_execution": ([], ["stdout", "stderr", "aggregated_output", "formatted_output", "exit_code"]),
    "mcp_tool_call": (["completed", "failed", "declined", "interrupted"], ["result", "error", "content_items", "success"]),
    "dynamic_tool_call": (["completed", "failed", "declined", "interrupted"], ["result", "error", "content_items", "success"]),
    "extension": (["completed", "failed", "interrupted"], ["result", "results", "error", "output"]),
    "web_search": (["completed", "failed", "interrupted"], ["action", "result"]),
    "image_generation": (["completed", "failed", "interrupted"], ["result", "output"]),
}
EXTENSION_KINDS = {"clock.sleep": "action", "web.search": "tool_call", "image_gen.generation": "tool_call"}


def item_type(text: Column) -> Column:
    """CamelCase or kebab names as snake case, if the type is known."""
    snake = F.lower(F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2"), r"[-\s]+", "_"))
    return F.when(snake.isin(list(ITEM_KINDS)), snake)


def item_kind(kind_of: Column, item: str, completed: Column) -> Column:
    """Kind of an item of a known type; a call that is completed and holds its result is that result."""
    status, extension = F.lower(F.expr(J.string_sql(item, "status"))), F.lower(F.expr(J.string_sql(item, "kind")))
    base = F.when(kind_of == "extension", F.coalesce(J.lookup(EXTENSION_KINDS, extension), F.lit("other"))).otherwise(J.lookup(ITEM_KINDS, kind_of))
    done = F.lit(False)
    for name, (statuses, fields) in ITEM_RESULTS.items():
        holds = [F.coalesce(status.isin(statuses), F.lit(False))] if statuses else []
        holds += [F.expr(J.get_sql(item, f)).isNotNull() for f in fields]
        any_of = holds[0]
        for h in holds[1:]:
            any_of = any_of | h
        done = F.when(kind_of == name, any_of).otherwise(done)
    return F.when((base == "tool_call") & completed & done, "tool_result").otherwise(base)


def _rollout_prepare(records: DataFrame) -> DataFrame:
    outer = s("type")
    bare = F.coalesce(outer.isin(list(RESPONSE_ITEMS)), F.lit(False))
    payload = F.when(bare, F.col(V)).otherwise(v("payload"))
    df = J.fence(records, _outer=outer, _bare=bare, _p=F.when(J.is_object(payload), payload))
    df = J.fence(df, _type=F.expr(J.string_sql("_p", "type")), _i=F.expr(J.get_sql("_p", "item")))
    item = (F.col("_outer") == "response_item") | F.col("_bare")
    msg = F.col("_outer") == "event_msg"
    df = J.fence(df, _item=F.coalesce(item, F.lit(False)), _msg=F.coalesce(msg, F.lit(False)), _life=F.coalesce(msg & F.col("_type").isin(LIFECYCLES), F.lit(False)), _it=item_type(F.expr(J.string_sql("_i", "type"))))
    kind = F.when(F.col("_item"), J.lookup(RESPONSE_ITEMS, F.col("_type"))).when(F.col("_life"), item_kind(F.col("_it"), "_i", F.col("_type") == "item_completed")).when(
        F.col("_msg"), J.lookup(EVENT_MESSAGES, F.col("_type"))).otherwise(J.lookup(OUTER, F.col("_outer")))
    return J.fence(df, _kind=F.coalesce(kind, F.lit("other")))


def _rollout_screen(records: DataFrame) -> DataFrame:
    """Payloads are only looked at where the outer type is known."""
    df = J.fence(records, _outer=s("type"))
    bare = F.coalesce(F.col("_outer").isin(list(RESPONSE_ITEMS)), F.lit(False))
    item, msg = (F.col("_outer") == "response_item") | bare, F.col("_outer") == "event_msg"
    payload = F.when(bare, F.col(V)).when(item | msg | F.col("_outer").isin(list(OUTER)), v("payload"))
    df = J.fence(df, _item=F.coalesce(item, F.lit(False)), _msg=F.coalesce(msg, F.lit(False)), _p=payload)
    return df.withColumn("_p", F.when(J.is_object(F.col("_p")), F.col("_p")))


def _p(*names: str) -> Column:
    return F.expr(J.coalesce_sql(*[J.string_sql("_p", n) for n in names]))


def _i(*names: str) -> Column:
    return F.expr(J.coalesce_sql(*[J.string_sql("_i", n) for n in names]))


def _is(*outer: str) -> Column:
    return F.col("_outer").isin(list(outer))


def _by_place(p, i, nothing: Column) -> dict[str, Column]:
    """Ids of rollout records; `p` reads names of the payload, `i` of an item in it, so that the same rules give values and their paths."""
    life, tools = F.col("_life"), F.col("_kind").isin("tool_call", "tool_result")
    called = p("call_id", "tool_call_id")
    response_call = F.when(F.col("_kind") == "tool_call", p("call_id", "id")).when(F.col("_kind") == "tool_result", called)
    return {
        "session_id": F.when(_is("session_meta"), p("id")).when(F.col("_msg"), p("thread_id", "session_id")).when(_is("token_usage_record"), p("session_id")).otherwise(nothing),
        "turn_id": F.when(F.col("_item") | F.col("_msg") | _is("turn_context", "token_usage_record"), p("turn_id")).otherwise(nothing),
        "message_id": F.when(life, i("id", "message_id")).when(F.col("_item"), p("id", "message_id")).when(_is("token_usage_record"), p("response_id")).otherwise(nothing),
        "parent_id": F.when(F.col("_item"), p("parent_id")).when(_is("inter_agent_communication_metadata"), p(*METADATA_PARENTS)).when(
            _is("inter_agent_communication"), p(*COMMUNICATION_PARENTS)).when(_is("token_usage_record"), p("root_turn_id")).otherwise(nothing),
        "tool_call_id": F.when(F.col("_item"), response_call).when(life, F.coalesce(called, F.when(tools, i(*ITEM_CALL_IDS)))).when(F.col("_msg"), called).otherwise(nothing),
        "subagent_id": F.when(life, i(*ITEM_AGENT_IDS)).when(F.col("_msg") & (F.col("_kind") == "subagent"), p(*AGENT_IDS)).when(
            _is("inter_agent_communication_metadata"), p(*METADATA_AGENTS)).when(_is("inter_agent_communication"), p(*COMMUNICATION_AGENTS)).otherwise(nothing),
    }


def _rollout() -> dict[str, Column]:
    kind, item, msg, life = F.col("_kind"), F.col("_item"), F.col("_msg"), F.col("_life")
    usage_at = F.expr(f"coalesce({J.get_sql('_p', 'usage')}, {J.get_sql('_p', 'info', 'total_token_usage')}, {J.get_sql('_p', 'info')})")
    body = F.expr(J.coalesce_sql(*[J.nonnull_sql("_p", k) for k in ("content", "arguments", "input", "action", "output", "last_agent_message", "message", "text", "summary", "error")]))
    held = F.expr(J.coalesce_sql(*[J.nonnull_sql("_i", k) for k in ("content", "text", "summary_text", "command", "tool", "name", "query", "output", "result", "message")]))
    item_actor = F.when(kind == "tool_result", "tool").when(kind == "subagent", "agent").when(F.col("_it") == "user_message", "user").when(
        kind.isin("message", "reasoning", "tool_call", "patch", "task", "action"), "assistant").otherwise("system")
    speaker = F.when(life, item_actor).when(item & (F.col("_type") == "message"), actor_from_role(_p("role"))).when(kind == "tool_result", "tool").when(
        msg & (F.col("_type") == "user_message"), "user").when(kind == "subagent", "agent").when(msg & kind.isin("turn", "result"), "assistant").when(
        msg & (kind == "action"), "system").when(kind.isin("message", "reasoning", "tool_call", "patch", "task", "action"), "assistant").otherwise("system")
    label = F.concat(F.coalesce(_p("name", "tool_name"), F.col("_type"), F.col("_outer"), F.lit("Record")))
    return {
        "event_kind": kind, "timestamp_raw": s("timestamp"), "actor": F.when((kind != "other") | life, speaker), **_by_place(_p, _i, F.lit(None).cast("string")),
        "model": _p("model"), "status": F.when(life, _i("status", "kind")).when(item, _p("status")),
        "severity": F.when(msg & ~life & (kind == "error"), F.coalesce(_p("severity"), F.lit("error"))).when(F.col("_outer") == "security_risk_score", "warning"),
        "usage": F.when(kind == "usage", J.usage(usage_at)), "summary": J.bounded_summary(F.coalesce(F.when(life, text_of(held)), text_of(body), F.col("_p"), F.col(V)), label),
        "confidence": F.when(F.col("_outer").isNotNull(), "source").otherwise("inferred"),
        "derived": derived(sourceType=F.coalesce("_type", "_outer").cast("variant"), lifecycle=F.when(life, F.regexp_replace("_type", "^item_", "")).cast("variant"),
                           wireItemType=F.when(life, F.expr(J.string_sql("_i", "type"))).cast("variant"), extensionKind=F.when(F.col("_it") == "extension", F.expr(J.string_sql("_i", "kind"))).cast("variant")),
    }


def _named(value: str, *base: str):
    """A reader of the display path of the first of some names that holds a string."""
    def path(*names: str) -> Column:
        return F.coalesce(*[F.when(F.expr(J.string_sql(value, n)).isNotNull(), F.lit(J.display_literal(*base, n))) for n in names])
    return path


def _rollout_evidence() -> dict[str, Column]:
    inside, bare = _named("_p", "payload"), _named("_p")
    paths = _by_place(lambda *n: F.when(F.col("_bare"), bare(*n)).otherwise(inside(*n)), _named("_i", "payload", "item"), F.lit(None).cast("string"))
    typed = F.when(F.col("_type").isNotNull() & (F.col("_item") | F.col("_msg")) & ~F.col("_bare"), F.when(F.col("_it").isNotNull() & F.col("_life"), "$.payload.item.type").otherwise("$.payload.type"))
    return {"event_kind": F.coalesce(typed, F.when(F.col("_outer").isNotNull(), "$.type")), "timestamp_raw": F.lit("$.timestamp"), **paths}


def _rollout_signals() -> dict[str, Column]:
    envelope = (F.col("_outer").isin(list(OUTER)) | F.col("_item") | F.col("_msg")) & F.col("_p").isNotNull() & s("timestamp").isNotNull()
    return {"shape": F.coalesce(envelope, F.lit(False))}


def share(cap: float):
    def score(sums, n):
        return F.least(F.lit(cap), cap * sums["shape"] / n), sums["shape"] > 0
    return score


ROLLOUT = Profile("codex-rollout", "1", _rollout, _rollout_signals, share(0.98), _rollout_prepare, _rollout_evidence, screen=_rollout_screen)

# ---- N3: exec streams ----------------------------------------------------------------

# Kinds and texts of stream types.
EXEC_TYPES = {"thread.started": "session", "turn.started": "turn", "turn.completed": "result", "turn.failed": "error", "error": "error"}
EXEC_TEXT = {"thread.started": "Thread started", "turn.started": "Turn started", "turn.completed": "Turn completed", "turn.failed": "Turn failed", "error": "Error"}


def _exec_prepare(records: DataFrame) -> DataFrame:
    df = J.fence(records, _type=s("type"), _it=item_type(s("item", "type")))
    return _exec_kind(J.fence(df, _i=v("item")))


def _exec_screen(records: DataFrame) -> DataFrame:
    df = J.fence(records, _type=s("type"))
    item = F.col("_type").startswith("item.")
    return _exec_kind(J.fence(df, _it=F.when(item, item_type(s("item", "type"))), _i=F.when(item, v("item"))))


def _exec_kind(df: DataFrame) -> DataFrame:
    kind = item_kind(F.col("_it"), "_i", F.col("_type") == "item.completed")
    return J.fence(df, _kind=F.coalesce(J.lookup(EXEC_TYPES, F.col("_type")), F.when(F.col("_type").startswith("item."), kind), F.lit("other")))


def _exec() -> dict[str, Column]:
    kind, is_item = F.col("_kind"), F.col("_type").like("item.%")
    actor = F.when(kind == "tool_result", "tool").when(kind == "subagent", "agent").when(F.col("_it") == "user_message", "user").when(
        kind.isin("message", "reasoning", "tool_call", "patch", "task", "action"), "assistant").otherwise("system")
    actor = F.when(F.col("_type").isin("turn.started", "turn.completed"), "assistant").otherwise(actor)
    body = F.expr(J.coalesce_sql(*[J.nonnull_sql(V, *p) for p in (("error",), ("message",), ("item", "text"), ("item", "command"), ("item",), ("thread_id",))]))
    failed = F.col("_type").isin("turn.failed", "error")
    return {
        "event_kind": kind, "timestamp_raw": either(("timestamp",), ("ts",)), "actor": F.when(kind != "other", actor), "session_id": s("thread_id"), "turn_id": s("turn_id"),
        "message_id": F.when(is_item, s("item", "id")), "tool_call_id": F.when(is_item & kind.isin("tool_call", "tool_result"), either(("item", "call_id"), ("item", "id"))),
        "status": F.when(F.col("_type") == "turn.failed", "failed").otherwise(s("item", "status")), "severity": F.when(failed, "error"),
        "usage": F.when(F.col("_type") == "turn.completed", J.usage(v("usage"))),
        "summary": J.bounded_summary(F.when(F.col("_type").isin("turn.started", "turn.completed"), None).otherwise(body), F.coalesce(J.lookup(EXEC_TEXT, F.col("_type")), F.col("_it"), F.lit("Item"))),
        "confidence": F.when(F.col("_type").isNotNull(), "source").otherwise("inferred"), "derived": derived(itemType=F.col("_it").cast("variant")),
    }


def _at(*names: str) -> Column:
    return _named(V)(*names)


def _exec_evidence() -> dict[str, Column]:
    item = _named("_i", "item")
    return {"event_kind": F.when(F.col("_it").isNotNull(), "$.item.type").otherwise("$.type"), "timestamp_raw": _at("timestamp", "ts"), "session_id": _at("thread_id"), "turn_id": _at("turn_id"),
            "message_id": item("id"), "tool_call_id": item("call_id", "id"), "status": item("status")}


EXEC = Profile("codex-exec-jsonl", "1", _exec, lambda: {"shape": F.col("_kind") != "other"}, share(0.96), _exec_prepare, _exec_evidence, screen=_exec_screen)

# ---- N4: trace bundles -----------------------------------------------------------------

# Kinds of trace payload types.
TRACE_KINDS = {
    "rollout_started": "session", "rollout_ended": "result", "thread_started": "session", "thread_ended": "result", "codex_turn_started": "turn", "codex_turn_ended": "result",
    "inference_started": "tool_call", "inference_completed": "result", "inference_failed": "error", "inference_cancelled": "error", "tool_call_started": "tool_call",
    "mcp_tool_call_correlation_assigned": "tool_call", "tool_call_runtime_started": "tool_call", "tool_call_runtime_ended": "tool_result", "tool_call_ended": "tool_result",
    "code_cell_started": "action", "code_cell_initial_response": "observation", "code_cell_ended": "result", "compaction_request_started": "checkpoint",
    "compaction_request_completed": "checkpoint", "compaction_request_failed": "error", "compaction_installed": "checkpoint", "agent_result_observed": "subagent",
    "protocol_event_observed": "other", "other": "other",
}


def _trace() -> dict[str, Column]:
    kind = F.coalesce(J.lookup(TRACE_KINDS, s("payload", "type")), F.lit("other"))
    ms = F.expr(J.number_sql(V, "wall_time_unix_ms"))
    return {
        "event_kind": kind, "timestamp_raw": ms.cast("bigint").cast("string"), "actor": F.lit("system"), "session_id": either(("thread_id",), ("rollout_id",)),
        "turn_id": s("codex_turn_id"), "tool_call_id": either(("payload", "tool_call_id"), ("payload", "call_id")), "severity": F.when(kind == "error", "error"),
        "summary": J.bounded_summary(v("payload"), s("payload", "type")), "confidence": F.when(s("payload", "type").isNotNull(), "source").otherwise("inferred"),
    }


def _trace_evidence() -> dict[str, Column]:
    return {"event_kind": F.lit("$.payload.type"), "timestamp_raw": F.lit("$.wall_time_unix_ms"), "session_id": _at("thread_id", "rollout_id"), "turn_id": _at("codex_turn_id"),
            "tool_call_id": F.coalesce(*[F.when(s("payload", n).isNotNull(), J.display_literal("payload", n)) for n in ("tool_call_id", "call_id")])}


TRACE = Profile("codex-trace", "1", _trace, lambda: {"shape": s("payload", "type").isin(list(TRACE_KINDS)) & s("rollout_id").isNotNull()}, share(0.97), evidence=_trace_evidence)

# ---- N5, N6: history and session index -----------------------------------------------------


def _history() -> dict[str, Column]:
    ok = s("session_id").isNotNull() & s("text").isNotNull() & F.expr(J.number_sql(V, "ts")).isNotNull()
    return {
        "event_kind": F.when(ok, "message").otherwise("other"), "actor": F.when(ok, "user"), "session_id": F.when(ok, s("session_id")),
        "timestamp_raw": F.when(ok, F.date_format(unix_seconds(v("ts")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), "summary": J.bounded_summary(F.when(ok, v("text")).otherwise(F.col(V))),
        "confidence": F.lit("source"), "derived": derived(sourceKind=F.lit("history").cast("variant")),
    }


HISTORY = Profile("codex-history", "1", _history, lambda: {"shape": s("session_id").isNotNull() & s("text").isNotNull() & v("ts").isNotNull()}, share(0.95),
                  evidence=lambda: {"event_kind": F.lit("$.text"), "session_id": F.lit("$.session_id"), "timestamp_raw": F.lit("$.ts"), "summary": F.lit("$.text")})


def _index() -> dict[str, Column]:
    ok = s("id").isNotNull() & s("thread_name").isNotNull() & s("updated_at").isNotNull()
    timed = is_rfc3339(s("updated_at"))
    return {
        "event_kind": F.when(ok, "session").otherwise("other"), "actor": F.when(ok, "system"), "session_id": F.when(ok, s("id")), "timestamp_raw": F.when(ok & timed, s("updated_at")),
        "summary": J.bounded_summary(F.when(ok, v("thread_name")).otherwise(F.col(V))), "confidence": F.lit("source"),
        "derived": derived(timestampRaw=F.when(ok & ~timed, s("updated_at")).cast("variant"), threadName=s("thread_name").cast("variant")),
    }


SESSION_INDEX = Profile("codex-session-index", "1", _index, lambda: {"shape": s("id").isNotNull() & s("thread_name").isNotNull() & s("updated_at").isNotNull()}, share(0.95),
                        evidence=lambda: {"event_kind": F.lit("$.id"), "session_id": F.lit("$.id"), "timestamp_raw": F.lit("$.updated_at"), "summary": F.lit("$.thread_name")})

# ---- N7: session transcripts -----------------------------------------------------------------

# Kinds of record types that carry no tool block.
TRANSCRIPT_TYPES = {
    "user": "message", "assistant": "message", "system": "checkpoint", "summary": "checkpoint", "mode": "checkpoint", "attachment": "checkpoint",
    "file-history-snapshot": "checkpoint", "file-history-delta": "checkpoint", "atis-latch": "checkpoint", "permission-mode": "approval", "progress": "observation",
    "queue-operation": "action", "ai-title": "session", "last-prompt": "message",
}


def _transcript_screen(records: DataFrame) -> DataFrame:
    return J.fence(records, _type=s("type"), _job=s("at").isNotNull() & s("state").isNotNull() & s("type").isNull(), _hist=v("display").isNotNull() & v("project").isNotNull() & s("type").isNull())


def _transcript_prepare(records: DataFrame) -> DataFrame:
    df = J.fence(_transcript_screen(records), _call=F.expr(_blocks(("message", "content"), "tool_use")), _result=F.expr(_blocks(("message", "content"), "tool_result")))
    broken = (F.col("_type") == "system") & ((s("subtype") == "error") | J.is_string(v("error")))
    kind = F.when(F.col("_job"), F.when(s("text").isNotNull(), "message").otherwise("observation")).when(F.col("_hist"), "message").when(
        F.col("_call").isNotNull(), "tool_call").when(F.col("_result").isNotNull(), "tool_result").when(broken, "error").otherwise(F.coalesce(J.lookup(TRANSCRIPT_TYPES, F.col("_type")), F.lit("other")))
    return J.fence(df, _kind=kind)


def _transcript() -> dict[str, Column]:
    kind, t = F.col("_kind"), F.col("_type")
    plain = ~F.col("_job") & ~F.col("_hist")
    actor = F.when(F.col("_hist"), "user").when(F.col("_job"), None).when(kind == "tool_call", "assistant").when(kind == "tool_result", "tool").when(
        t.isin("user", "assistant"), actor_from_role(F.coalesce(s("message", "role"), t))).when(t == "last-prompt", "user").when(t.isin(list(TRANSCRIPT_TYPES)), "system")
    name = F.expr(f"coalesce({J.string_sql('_call', 'name')}, 'tool')")
    body = F.when(F.col("_job"), F.coalesce(s("text").cast("variant"), v("detail"))).when(F.col("_hist"), v("display")).when(kind == "tool_call", F.expr(J.get_sql("_call", "input"))).when(
        kind == "tool_result", F.expr(J.get_sql("_result", "content"))).when(t.isin("user", "assistant"), text_of(v("message", "content"))).otherwise(
        F.expr(J.coalesce_sql(*[J.nonnull_sql(V, k) for k in ("message", "content", "summary", "lastPrompt", "prompt", "permissionMode", "mode", "data", "operation", "aiTitle", "title", "snapshot")])))
    label = F.when(F.col("_job"), F.concat(F.lit("Job "), s("state"))).when(F.col("_hist"), "Command").when(kind == "tool_call", F.concat(F.lit("Tool "), name)).when(
        kind == "tool_result", "Tool result").when(t.isin("user", "assistant"), F.concat(t, F.lit(" message"))).otherwise(F.coalesce(s("subtype"), t, F.lit("Record")))
    epoch = F.expr(J.number_sql(V, "timestamp")).cast("bigint").cast("string")
    return {
        "event_kind": kind, "actor": actor, "timestamp_raw": F.when(F.col("_job"), s("at")).when(F.col("_hist"), epoch).otherwise(s("timestamp")), "session_id": s("sessionId"),
        "message_id": F.when(plain, either(("uuid",), ("leafUuid",))), "parent_id": s("parentUuid"), "model": s("message", "model"), "subagent_id": s("agentId"),
        "tool_call_id": F.when(kind == "tool_call", F.expr(J.string_sql("_call", "id"))).when(kind == "tool_result", F.expr(J.string_sql("_result", "tool_use_id"))),
        "status": F.when(F.col("_job"), s("state")).when(t == "permission-mode", either(("permissionMode",), ("mode",))).when(t == "mode", s("mode")),
        "severity": F.when(kind == "error", "error"), "usage": J.usage(v("message", "usage")), "summary": J.bounded_summary(F.coalesce(body, F.col(V)), label),
        "confidence": F.when(t.isNotNull() | ~plain, "source").otherwise("inferred"), "derived": derived(sourceType=t.cast("variant"), sourceSubtype=s("subtype").cast("variant")),
    }


def _transcript_signals() -> dict[str, Column]:
    known = F.col("_type").isin(list(TRANSCRIPT_TYPES)) & s("sessionId").isNotNull()
    return {"shape": F.coalesce(known | F.col("_job") | F.col("_hist"), F.lit(False))}


def _block_path(kind: str, name: str) -> Column:
    """Display path of a field of the first content block of a kind."""
    items = f"try_variant_get({V}, {J.sql_text(J.jsonpath('message', 'content'))}, 'array<variant>')"
    at = F.expr(f"array_position(transform({items}, b -> coalesce({J.string_sql('b', 'type')}, '')), '{kind}')")
    return F.when(at > 0, F.concat(F.lit("$.message.content["), (at - 1).cast("string"), F.lit(f"].{name}")))


def _transcript_evidence() -> dict[str, Column]:
    kind = F.col("_kind")
    return {
        "event_kind": F.when(F.col("_job"), "$.state").when(F.col("_hist"), "$.display").when(kind == "tool_call", _block_path("tool_use", "type")).when(
            kind == "tool_result", _block_path("tool_result", "type")).otherwise("$.type"),
        "timestamp_raw": F.when(F.col("_job"), "$.at").otherwise("$.timestamp"), "session_id": _at("sessionId"), "message_id": _at("uuid", "leafUuid"), "parent_id": _at("parentUuid"),
        "subagent_id": _at("agentId"), "model": F.lit("$.message.model"), "usage": F.lit("$.message.usage"),
        "tool_call_id": F.when(kind == "tool_call", _block_path("tool_use", "id")).when(kind == "tool_result", _block_path("tool_result", "tool_use_id")),
    }


TRANSCRIPT = Profile("claude-code-session", "3", _transcript, _transcript_signals, share(0.97), _transcript_prepare, _transcript_evidence, screen=_transcript_screen)

# ---- N8: sessions with typed messages ------------------------------------------------------------

# Roles of messages, and kinds of record types without a message.
PI_ROLES = ["user", "assistant", "toolResult", "system", "custom", "bashExecution", "branchSummary", "compactionSummary"]
PI_TYPES = {"session": "session", "session_info": "session", "model_change": "checkpoint", "thinking_level_change": "checkpoint", "custom_message": "message"}


def _pi_prepare(records: DataFrame) -> DataFrame:
    return _pi_kind(J.fence(records, _type=s("type"), _role=s("message", "role"), _call=F.expr(_blocks(("message", "content"), "toolCall"))))


def _pi_screen(records: DataFrame) -> DataFrame:
    """Messages are only looked into where the type says that there is one."""
    df = J.fence(records, _type=s("type"))
    message = F.col("_type") == "message"
    return _pi_kind(J.fence(df, _role=F.when(message, s("message", "role")), _call=F.when(message, F.expr(_blocks(("message", "content"), "toolCall")))))


def _pi_kind(df: DataFrame) -> DataFrame:
    role = F.col("_role")
    message = F.when(role == "toolResult", "tool_result").when(F.col("_call").isNotNull(), "tool_call").when(role.isin("system", "branchSummary", "compactionSummary"), "checkpoint").when(
        role == "bashExecution", "action").when(role.isin(PI_ROLES), "message").otherwise("other")
    kind = F.when((F.col("_type") == "message") & v("message").isNotNull(), message).otherwise(
        J.lookup(PI_TYPES, F.col("_type")))
    return J.fence(df, _kind=F.coalesce(kind, F.lit("other")))


def _pi() -> dict[str, Column]:
    kind, role, t = F.col("_kind"), F.col("_role"), F.col("_type")
    failed = F.expr(f"try_variant_get({V}, '$.message.isError', 'boolean')")
    actor = F.when(t == "custom_message", "agent").when(t == "message", F.when(role == "toolResult", "tool").when(role.isin("branchSummary", "compactionSummary"), "system").when(
        role == "bashExecution", "user").otherwise(actor_from_role(role))).otherwise("system")
    body = F.expr(J.coalesce_sql(*[J.nonnull_sql(V, *p) for p in (("message", "summary"), ("content",), ("modelId",), ("thinkingLevel",), ("name",))]))
    return {
        "event_kind": kind, "actor": F.when(kind != "other", actor), "timestamp_raw": s("timestamp"), "session_id": F.when(t == "session", s("id")),
        "message_id": F.when(t.isin("message", "custom_message"), s("id")), "parent_id": F.when(t.isin("message", "custom_message"), s("parentId")),
        "model": F.coalesce(s("modelId"), s("message", "model")), "tool_call_id": F.when(kind == "tool_result", s("message", "toolCallId")).otherwise(F.expr(J.string_sql("_call", "id"))),
        "status": F.when(role == "toolResult", F.when(failed, "error").when(~failed, "success")).otherwise(s("thinkingLevel")), "severity": F.when((role == "toolResult") & failed, "error"),
        "usage": J.usage(v("message", "usage")), "summary": J.bounded_summary(F.coalesce(text_of(v("message", "content")), body, F.col(V)), F.coalesce(role, t, F.lit("Record"))),
        "confidence": F.when(t.isNotNull(), "source").otherwise("inferred"),
    }


def _pi_evidence() -> dict[str, Column]:
    call = F.when(F.col("_kind") == "tool_result", F.lit("$.message.toolCallId")).otherwise(_block_path("toolCall", "id"))
    return {"event_kind": F.when(F.col("_role").isNotNull(), "$.message.role").otherwise("$.type"), "timestamp_raw": F.lit("$.timestamp"), "session_id": F.lit("$.id"), "message_id": _at("id"),
            "parent_id": _at("parentId"), "tool_call_id": call, "usage": F.lit("$.message.usage")}


PI = Profile("pi-coding-agent", "1", _pi, lambda: {"shape": (F.col("_kind") != "other") & (s("id").isNotNull() | v("message").isNotNull()) & s("timestamp").isNotNull() & s("sessionId").isNull()}, share(0.9), _pi_prepare, _pi_evidence, screen=_pi_screen)
