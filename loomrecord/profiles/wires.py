"""Wire logs and server journals of coding sessions as events.

Two kinds of files hold one family. A wire log has one typed record per line, whose
messages and loop events nest one level deeper; a journal wraps each event in a numbered
envelope. `prepare` finds the form of a record and the object its fields are read from
(`_b`), so that one set of columns serves all forms. Every line is judged by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.functions.times import text_to_ms
from loomrecord.profiles.base import Profile, actor_from_role, derived

# Kinds of wire records that hold the fields of their type.
CHECKED_KINDS = {
    "runtime.set_binding": "observation", "permission.set_mode": "observation", "plugin.session_start": "session", "agent.turn.started": "turn",
    "agent.turn.ended": "turn", "turn.ended": "turn", "llm.request": "observation", "usage.record": "observation", "token_counting.measured": "observation",
    "token_counting.turn_recorded": "observation", "task.terminated": "task", "turn.prompt": "message", "turn.steer": "message", "prompt.completed": "turn",
    "llm.tools_snapshot": "observation", "config.update": "session", "profile.bind": "session", "mcp.tools_discovered": "observation",
    "tools.set_active_tools": "observation", "prompt.steered": "message",
}
# Kinds of wire records known by their type alone.
OPEN_KINDS = {
    "metadata": "session", "context.clear": "checkpoint", "context.undo": "checkpoint", "context.undone": "checkpoint", "context.apply_compaction": "checkpoint",
    "full_compaction.begin": "checkpoint", "full_compaction.cancel": "checkpoint", "full_compaction.complete": "checkpoint", "task.started": "task",
    "turn.step.interrupted": "turn", "turn.step.retrying": "error", "prompt.aborted": "turn",
}
LOOP_KINDS = {"content.part": "message", "tool.call": "tool_call", "tool.result": "tool_result", "step.begin": "turn", "step.end": "turn"}
# Kinds of journal events.
JOURNAL_KINDS = {
    "agent.status.updated": "observation", "agent.created": "observation", "agent.disposed": "observation", "session.meta.updated": "session",
    "event.session.created": "session", "event.session.archived": "session", "event.session.deleted": "session", "event.workspace.created": "observation",
    "event.workspace.updated": "observation", "event.workspace.deleted": "observation", "event.session.work_changed": "session",
    "event.session.status_changed": "session", "event.config.changed": "observation", "event.config.warning": "observation",
    "event.model_catalog.changed": "observation", "event.plugin.changed": "observation", "event.capability.changed": "observation",
    "event.di.unit_changed": "observation", "goal.updated": "observation", "skill.activated": "observation", "plugin_command.activated": "observation",
    "error": "error", "warning": "observation", "turn.started": "turn", "turn.ended": "turn", "turn.step.started": "turn", "turn.step.completed": "turn",
    "turn.step.retrying": "error", "turn.step.interrupted": "turn", "assistant.delta": "message", "hook.result": "message", "thinking.delta": "reasoning",
    "tool.call.delta": "tool_call", "tool.call.started": "tool_call", "tool.progress": "observation", "tool.result": "tool_result", "shell.output": "task",
    "shell.started": "task", "shell.completed": "task", "subagent.spawned": "subagent", "subagent.started": "subagent", "subagent.suspended": "subagent",
    "subagent.completed": "subagent", "subagent.failed": "subagent", "subagent.cancelled": "subagent", "compaction.started": "checkpoint",
    "compaction.blocked": "checkpoint", "compaction.cancelled": "checkpoint", "compaction.completed": "checkpoint", "task.started": "task",
    "task.terminated": "task", "background.task.started": "task", "background.task.terminated": "task", "cron.fired": "task", "prompt.submitted": "message",
    "prompt.completed": "turn", "prompt.aborted": "turn", "prompt.steered": "message", "tool.list.updated": "observation", "mcp.server.status": "observation",
    "context.spliced": "checkpoint", "prompt.queued": "message", "prompt.started": "turn", "turn.steer": "message", "task.notified": "task",
    "plan.revision": "checkpoint", "event.question.requested": "approval", "event.question.dismissed": "approval", "event.question.answered": "approval",
    "event.approval.requested": "approval", "event.approval.resolved": "approval",
}
# Statuses that a type alone tells.
TYPE_STATUS = {
    "wire agent.turn.started": "running", "wire full_compaction.begin": "running", "wire full_compaction.cancel": "cancelled", "wire full_compaction.complete": "completed",
    "wire turn.step.interrupted": "interrupted", "wire turn.step.retrying": "retrying", "wire prompt.aborted": "aborted", "loop step.begin": "running",
    "journal prompt.aborted": "aborted", "journal prompt.started": "running", "journal prompt.queued": "queued", "journal turn.started": "running",
    "journal turn.step.started": "running", "journal turn.step.retrying": "retrying", "journal turn.step.interrupted": "interrupted", "journal shell.started": "running",
}
# The texts summaries begin with; journal events begin as an unlisted type does.
LABELS = {
    "wire metadata": "Kimi wire protocol", "wire llm.tools_snapshot": "Kimi tools snapshot", "wire mcp.tools_discovered": "Kimi MCP discovery",
    "wire tools.set_active_tools": "Kimi active tools", "wire prompt.steered": "Kimi prompt", "wire task.started": "Kimi task",
    "wire turn.step.interrupted": "Kimi turn.step.interrupted", "wire turn.step.retrying": "Kimi turn.step.retrying", "wire prompt.aborted": "Kimi prompt",
    "wire runtime.set_binding": "Kimi runtime binding", "wire permission.set_mode": "Kimi permission mode", "wire plugin.session_start": "Kimi plugin session start",
    "wire agent.turn.started": "Kimi agent turn started", "wire agent.turn.ended": "Kimi agent turn ended", "wire turn.ended": "Kimi turn ended",
    "wire llm.request": "Kimi LLM request", "wire usage.record": "Kimi usage", "wire token_counting.measured": "Kimi token measurement",
    "wire token_counting.turn_recorded": "Kimi token measurement", "wire task.terminated": "Kimi task ended", "wire turn.prompt": "Kimi prompt",
    "wire turn.steer": "Kimi prompt", "wire prompt.completed": "Kimi prompt completed", "loop content.part": "Kimi assistant", "loop tool.call": "Kimi tool",
    "loop tool.result": "Kimi tool result",
}
MESSAGE_ROLES = ["system", "user", "assistant", "tool"]
PROMPTS = ["prompt.submitted", "prompt.steered", "prompt.queued", "turn.steer"]
WHOLE = 2**53 - 1  # the largest integer the format writes exactly
TOOLS, PARTS, TEXT, IDENTITY = 32, 16, 240, 2048  # kept limits: tools looked at, parts and characters of a preview, characters of an id


# ---- predicates over one object, as SQL text -----------------------------------------------


def _has(v: str, kind: str, *path: str) -> str:
    return f"coalesce(schema_of_variant({J.get_sql(v, *path)}) LIKE '{kind}%', false)"


def _texts(v: str, *fields: str) -> str:
    return " AND ".join(_has(v, "STRING", f) for f in fields)


def _whole_sql(v: str, *path: str, least: int = -WHOLE) -> str:
    """An exact integer of at least `least`, as DOUBLE, else NULL."""
    return J.bind_sql(J.number_sql(v, *path), "d", f"if(d = floor(d) AND d BETWEEN {least} AND {WHOLE}, d, null)")


def _whole(v: str, *path: str, least: int = -WHOLE) -> str:
    return f"({_whole_sql(v, *path, least=least)}) IS NOT NULL"


def _absent_or(v: str, condition: str, *path: str) -> str:
    return f"({J.get_sql(v, *path)} IS NULL OR {condition})"


def _text_list(v: str, *path: str) -> str:
    return f"coalesce(forall(try_variant_get({J.get_sql(v, *path)}, '$', 'array<variant>'), i -> schema_of_variant(i) = 'STRING'), false)"


def _among(v: str, values: list[str], *path: str) -> str:
    return f"coalesce({J.string_sql(v, *path)} IN ({', '.join(J.sql_text(x) for x in values)}), false)"


def _tool_list(v: str, needs: str) -> str:
    return f"coalesce(forall(slice(try_variant_get({J.get_sql(v, 'tools')}, '$', 'array<variant>'), 1, {TOOLS}), i -> {J.string_sql('i', 'name')} IS NOT NULL AND {J.string_sql('i', 'description')} IS NOT NULL AND {needs}), false)"


def _journal_sql(v: str) -> str:
    """Whether a record is an enveloped journal event whose numbers and types agree."""
    kind = J.string_sql(v, "envelope", "type")
    return " AND ".join([
        f"coalesce({J.string_sql(v, 'kind')} = 'event', false)", f"coalesce(({_whole_sql(v, 'seq', least=1)}) = ({_whole_sql(v, 'envelope', 'seq', least=1)}), false)",
        _has(v, "OBJECT", "envelope", "payload"), f"{kind} IS NOT NULL", f"{J.string_sql(v, 'envelope', 'timestamp')} IS NOT NULL",
        _absent_or(v, f"coalesce({J.string_sql(v, 'envelope', 'payload', 'type')} = {kind}, false)", "envelope", "payload", "type"),
        _absent_or(v, f"{J.string_sql(v, 'envelope', 'epoch')} IS NOT NULL", "envelope", "epoch"), _absent_or(v, _has(v, "STRING", "envelope", "session_id"), "envelope", "session_id"),
        _absent_or(v, _has(v, "BOOLEAN", "envelope", "volatile"), "envelope", "volatile"), _absent_or(v, _whole(v, "envelope", "offset", least=0), "envelope", "offset")])


def _header_sql(v: str) -> str:
    return f"coalesce({J.string_sql(v, 'kind')} = 'journal_header' AND {J.number_sql(v, 'version')} = 1, false) AND {J.string_sql(v, 'epoch')} IS NOT NULL AND {_whole(v, 'created_at', least=0)}"


def _metadata_sql(v: str) -> str:
    return f"coalesce({J.string_sql(v, 'protocol_version')} rlike '^1[.][0-9]{{1,3}}$', false) AND {_whole(v, 'created_at', least=0)}"


def _appended_sql(v: str) -> str:
    return f"{_among(v, ['event'], 'kind')} AND {_among(v, MESSAGE_ROLES, 'message', 'message', 'role')} AND {_has(v, 'ARRAY', 'message', 'message', 'content')}"


def _checked_sql(v: str) -> str:
    """Whether a wire record holds what its type, read before as `_wt`, must hold."""
    agent = _has(v, "STRING", "agentId")
    some_agent = _absent_or(v, agent, "agentId")
    event = {
        "step.begin": f"{J.string_sql(v, 'event', 'uuid')} IS NOT NULL", "step.end": f"{J.string_sql(v, 'event', 'uuid')} IS NOT NULL",
        "content.part": f"{J.string_sql(v, 'event', 'stepUuid')} IS NOT NULL AND {J.string_sql(v, 'event', 'part', 'type')} IS NOT NULL",
        "tool.call": f"{J.string_sql(v, 'event', 'stepUuid')} IS NOT NULL AND {J.string_sql(v, 'event', 'toolCallId')} IS NOT NULL AND ({J.string_sql(v, 'event', 'name')} IS NOT NULL OR {J.get_sql(v, 'event', 'command')} IS NOT NULL "
                     f"OR {J.string_sql(v, 'event', 'display', 'command')} IS NOT NULL OR {J.string_sql(v, 'event', 'args', 'command')} IS NOT NULL)",
        "tool.result": f"{J.string_sql(v, 'event', 'toolCallId')} IS NOT NULL AND ({_has(v, 'STRING', 'event', 'result', 'output')} OR {_has(v, 'ARRAY', 'event', 'result', 'output')})",
    }
    loop = f"CASE {J.string_sql(v, 'event', 'type')} " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in event.items()) + " ELSE false END"
    asked = f"{some_agent} AND {_has(v, 'ARRAY', 'input')} AND {J.string_sql(v, 'origin', 'kind')} IS NOT NULL"
    counted = f"{agent} AND {_whole(v, 'length', least=0)} AND {_whole(v, 'tokens', least=0)}"
    rules = {
        "metadata": _metadata_sql(v),
        "llm.tools_snapshot": f"{J.string_sql(v, 'agentId')} IS NOT NULL AND {J.string_sql(v, 'hash')} IS NOT NULL AND " + _tool_list(v, _has("i", "OBJECT", "parameters")),
        "task.started": f"coalesce({J.string_sql(v, 'info', 'description')}, {J.string_sql(v, 'description')}) IS NOT NULL",
        "prompt.steered": _has(v, "ARRAY", "content"),
        "config.update": "(" + " OR ".join(_has(v, "STRING", f) for f in ("systemPrompt", "modelAlias", "profileName", "thinkingEffort", "thinkingLevel")) + ")",
        "profile.bind": f"{_texts(v, 'agentId', 'thinkingEffort', 'systemPrompt')} AND {_text_list(v, 'disallowedTools')}",
        "runtime.set_binding": _texts(v, "agentId", "workspaceId", "runtimeId"), "permission.set_mode": _texts(v, "agentId", "mode"),
        "plugin.session_start": f"{agent} AND ({_has(v, 'STRING', 'content')} OR coalesce(is_variant_null({J.get_sql(v, 'content')}), false))",
        "agent.message.appended": _appended_sql(v),
        "agent.turn.started": f"{_among(v, ['event'], 'kind')} AND {_whole(v, 'turnId')} AND {_absent_or(v, _has(v, 'STRING', 'queueItemId'), 'queueItemId')}",
        "agent.turn.ended": f"{_among(v, ['event'], 'kind')} AND {_whole(v, 'turnId')} AND {_among(v, ['done', 'failed', 'aborted'], 'outcome')}",
        "turn.ended": f"{agent} AND {_whole(v, 'turnId')} AND {_among(v, ['completed', 'cancelled', 'failed', 'blocked'], 'reason')}",
        "llm.request": f"{_texts(v, 'agentId', 'provider', 'model', 'systemPromptHash', 'toolsHash')} AND {_among(v, ['loop', 'compaction'], 'kind')} AND {_has(v, 'BOOLEAN', 'toolSelect')} AND {_whole(v, 'messageCount')}",
        "usage.record": f"{_texts(v, 'agentId', 'model')} AND " + " AND ".join(_whole(v, "usage", f, least=0) for f in ("inputOther", "output", "inputCacheRead", "inputCacheCreation")),
        "token_counting.measured": counted, "token_counting.turn_recorded": f"{counted} AND {_whole(v, 'turnId')}",
        "task.terminated": f"{agent} AND " + " AND ".join(_has(v, "STRING", "info", f) for f in ("taskId", "description", "kind")) + f" AND {_among(v, ['running', 'completed', 'failed', 'timed_out', 'killed', 'lost'], 'info', 'status')} "
                           f"AND {_whole(v, 'info', 'startedAt')} AND (coalesce(is_variant_null({J.get_sql(v, 'info', 'endedAt')}), false) OR {_whole(v, 'info', 'endedAt')})",
        "turn.steer": asked, "turn.prompt": asked,
        "prompt.completed": f"{_texts(v, 'agentId', 'finishedAt')} AND {J.string_sql(v, 'promptId')} IS NOT NULL AND {_among(v, ['completed', 'failed', 'blocked'], 'reason')}",
        "mcp.tools_discovered": f"{some_agent} AND {J.string_sql(v, 'serverName')} IS NOT NULL AND {J.string_sql(v, 'hash')} IS NOT NULL AND {_text_list(v, 'enabledNames')} AND " + _tool_list(v, f"{J.get_sql('i', 'inputSchema')} IS NOT NULL"),
        "tools.set_active_tools": f"{some_agent} AND {_text_list(v, 'names')}",
        "context.append_message": f"{_among(v, MESSAGE_ROLES, 'message', 'role')} AND {_has(v, 'ARRAY', 'message', 'content')} AND {_has(v, 'ARRAY', 'message', 'toolCalls')}",
        "context.append_loop_event": f"({loop})",
    }
    return "CASE _wt " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in rules.items()) + " ELSE false END"


def error_sql(v: str) -> str:
    """The error flag of a record in a place its form gives a meaning to; NULL otherwise."""
    def flag(*path: str) -> str:
        g = J.get_sql(v, *path)
        return f"if(schema_of_variant({g}) = 'BOOLEAN', try_variant_get({g}, '$', 'boolean'), null)"
    told = [t for t in JOURNAL_KINDS if t.startswith(("tool.call", "tool.progress", "tool.result", "shell."))]
    return (f"CASE WHEN {_journal_sql(v)} THEN if({_among(v, told, 'envelope', 'type')}, {flag('envelope', 'payload', 'isError')}, null) "
            f"WHEN {J.string_sql(v, 'type')} = 'agent.message.appended' AND {_appended_sql(v)} THEN {flag('message', 'message', 'isError')} WHEN {J.string_sql(v, 'type')} = 'context.append_message' THEN {flag('message', 'isError')} "
            f"WHEN {J.string_sql(v, 'type')} = 'context.append_loop_event' AND {J.string_sql(v, 'event', 'type')} = 'tool.result' THEN {flag('event', 'result', 'isError')} END")


# ---- parts of a record ------------------------------------------------------------------------


def _preview_sql(value: str, journal: str) -> str:
    """Text of content parts; media and hidden reasoning are named, not shown. `journal` is a condition."""
    thought = f"coalesce({J.string_sql('p', 'think')}, if({journal}, {J.string_sql('p', 'thinking')}, null))"
    sealed = f"(coalesce(try_variant_get(p, '$.hidden', 'boolean'), false) OR {J.get_sql('p', 'encrypted')} IS NOT NULL OR ({journal} AND {J.get_sql('p', 'signature')} IS NOT NULL))"
    output = f"if(schema_of_variant({J.get_sql('p', 'output')}) = 'STRING', try_variant_get(p, '$.output', 'string'), '[tool output]')"
    own = (f"CASE WHEN t = 'text' THEN {J.string_sql('p', 'text')} WHEN t = 'think' OR ({journal} AND t = 'thinking') THEN if({sealed}, '[hidden reasoning]', {thought}) "
           f"WHEN t IN ('image_url', 'audio_url', 'video_url') THEN concat('[', left(t, length(t) - 4), ' reference]') WHEN {journal} AND t IN ('image', 'video', 'file') THEN concat('[', t, ' reference]') "
           f"WHEN {journal} AND t = 'tool_use' THEN concat('[tool ', coalesce(left({J.string_sql('p', 'tool_name')}, 64), 'call'), ']') WHEN {journal} AND t = 'tool_result' THEN {output} "
           f"WHEN t IS NOT NULL THEN concat('[', left(t, 48), ']') END")
    parts = f"transform(slice(try_variant_get(c, '$', 'array<variant>'), 1, {PARTS}), p -> {J.bind_sql(J.string_sql('p', 'type'), 't', own)})"
    joined = f"array_join(filter({parts}, x -> x != ''), ' ')"
    return J.bind_sql(value, "c", f"nullif(left(if(schema_of_variant(c) = 'STRING', try_variant_get(c, '$', 'string'), {joined}), {TEXT}), '')")


def _usage(value: str) -> Column:
    """Counters; the input is the sum of the three input counters, when all are there."""
    raw = f"named_struct('i', {_whole_sql(value, 'inputOther', least=0)}, 'h', {_whole_sql(value, 'inputCacheRead', least=0)}, 'w', {_whole_sql(value, 'inputCacheCreation', least=0)}, 'o', {_whole_sql(value, 'output', least=0)})"
    built = J.bind_sql(raw, "r", "named_struct('input', r.i + r.h + r.w, 'output', r.o, 'cached', r.h, 'total', r.i + r.h + r.w + r.o)")
    return F.expr(J.bind_sql(built, "u", "if(coalesce(u.input, u.output, u.cached) IS NULL, null, u)"))


def _b(*path: str) -> Column:
    return F.expr(J.string_sql("_b", *path))


def _first(*paths: tuple[str, ...]) -> Column:
    return F.expr(J.coalesce_sql(*[J.string_sql("_b", *p) for p in paths]))


def _flag(*path: str) -> Column:
    g = J.get_sql("_b", *path)
    return F.expr(f"if(schema_of_variant({g}) = 'BOOLEAN', try_variant_get({g}, '$', 'boolean'), null)")


def _size(*path: str) -> Column:
    return F.expr(f"size(try_variant_get({J.get_sql('_b', *path)}, '$', 'array<variant>'))")


def _key(*keys: str) -> Column:
    return F.col("_key").isin(list(keys))


def _instant(value: str, *path: str) -> Column:
    """ISO text of epoch milliseconds."""
    return F.date_format(F.timestamp_millis(F.expr(_whole_sql(value, *path, least=0)).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _id(value: Column) -> Column:
    return F.when(F.length(value) <= IDENTITY, value)


def _screen(records: DataFrame) -> DataFrame:
    """The form of each record, its type and the object its fields are read from."""
    v = "value"
    kind = J.string_sql(v, "type")
    # The checks of all types are wide: each is computed once per row and kept.
    df = J.fence(records, _wt=F.expr(kind), _journal=F.expr(_journal_sql(v)), _header=F.expr(_header_sql(v)))
    df = J.fence(df, _checked=F.when(~F.col("_journal") & ~F.col("_header"), F.expr(_checked_sql(v))).otherwise(False))
    wt = F.col("_wt")
    appended = (wt == "agent.message.appended") & F.col("_checked")
    form = F.when(F.col("_journal"), "journal").when(F.col("_header"), "header").when(appended | (wt == "context.append_message") & F.expr(_has(v, "OBJECT", "message")), "message").when(
        (wt == "context.append_loop_event") & F.expr(_has(v, "OBJECT", "event")), "loop").otherwise("wire")
    df = J.fence(df, _form=form)
    body = f"CASE _form WHEN 'journal' THEN {J.get_sql(v, 'envelope', 'payload')} WHEN 'message' THEN if(_wt = 'agent.message.appended', {J.get_sql(v, 'message', 'message')}, {J.get_sql(v, 'message')}) WHEN 'loop' THEN {J.get_sql(v, 'event')} ELSE value END"
    at = "CASE _form WHEN 'journal' THEN '$.envelope.payload' WHEN 'message' THEN if(_wt = 'agent.message.appended', '$.message.message', '$.message') WHEN 'loop' THEN '$.event' ELSE '$' END"
    df = J.fence(df, _b=F.expr(body), _at=F.expr(at))
    t = F.expr(f"CASE _form WHEN 'journal' THEN {J.string_sql(v, 'envelope', 'type')} WHEN 'message' THEN {J.string_sql('_b', 'role')} WHEN 'loop' THEN {J.string_sql('_b', 'type')} WHEN 'wire' THEN _wt END")
    return J.fence(df, _t=t)


def _prepare(records: DataFrame) -> DataFrame:
    df = J.fence(_screen(records), _calls=F.expr("try_variant_get(_b, '$.toolCalls', 'array<variant>')"))
    preview = {"journal": f"CASE WHEN _t = 'turn.steer' THEN {J.get_sql('_b', 'input')} WHEN _t = 'tool.result' THEN {J.get_sql('_b', 'output')} ELSE {J.get_sql('_b', 'content')} END",
               "message": J.get_sql("_b", "content"),
               "loop": f"if(_t = 'tool.result', {J.get_sql('_b', 'result', 'output')}, to_variant_object(array({J.get_sql('_b', 'part')})))",
               "wire": f"CASE WHEN _t IN ('turn.prompt', 'turn.steer') THEN {J.get_sql('_b', 'input')} WHEN _t = 'context.apply_compaction' THEN {J.get_sql('_b', 'summary', 'content')} ELSE {J.get_sql('_b', 'content')} END"}
    shown = "CASE _form " + " ".join(f"WHEN '{f}' THEN {e}" for f, e in preview.items()) + " END"
    spliced = f"array_join(filter(transform(slice(try_variant_get(_b, '$.messages', 'array<variant>'), 1, {PARTS}), m -> {_preview_sql(J.get_sql('m', 'content'), 'true')}), x -> x IS NOT NULL), ' ')"
    text = F.expr(f"if(_form = 'journal' AND _t = 'context.spliced', nullif(left({spliced}, {TEXT}), ''), {_preview_sql(shown, "_form = 'journal'")})")
    df = J.fence(df, _text=text, _key=F.concat(F.col("_form"), F.lit(" "), F.coalesce("_t", F.lit(""))))
    wire = F.when(F.col("_checked"), J.lookup(CHECKED_KINDS, F.col("_t")))
    message = F.when(F.col("_t") == "tool", "tool_result").when((F.col("_t") == "assistant") & (F.size("_calls") > 0), "tool_call").otherwise("message")
    loop = F.when((F.col("_t") == "content.part") & (_b("part", "type") == "think"), "reasoning").otherwise(J.lookup(LOOP_KINDS, F.col("_t")))
    journal = F.when((F.col("_t") == "context.spliced") & F.col("_text").isNotNull(), "message").otherwise(J.lookup(JOURNAL_KINDS, F.col("_t")))
    found = F.when(F.col("_form") == "journal", journal).when(F.col("_form") == "header", "session").when(F.col("_form") == "message", message).when(
        F.col("_form") == "loop", loop).otherwise(F.coalesce(wire, J.lookup(OPEN_KINDS, F.col("_t"))))
    return J.fence(df, _kind=F.coalesce(found, F.lit("other")))


def _detail() -> Column:
    """What a summary shows after its label."""
    t, kind, text, form = F.col("_t"), F.col("_kind"), F.col("_text"), F.col("_form")
    names = F.expr(f"nullif(array_join(filter(transform(slice(try_variant_get(_b, '$.names', 'array<variant>'), 1, {TOOLS}), n -> try_variant_get(n, '$', 'string')), n -> n IS NOT NULL), ', '), '')")
    wire = F.when(t == "metadata", F.coalesce(_b("protocol_version"), F.lit("unknown"))).when(t == "llm.tools_snapshot", _size("tools").cast("string")).when(
        t == "mcp.tools_discovered", F.concat(_size("tools").cast("string"), F.lit(" tools from "), _b("serverName"))).when(t == "tools.set_active_tools", F.coalesce(names, _size("names").cast("string"))).when(
        t == "context.apply_compaction", F.coalesce(_first(("summary",), ("contextSummary",)), text, t)).when(t == "prompt.steered", F.coalesce(text, t)).when(
        t.isin("task.started", "task.terminated"), F.coalesce(_first(("info", "description"), ("description",)), t)).when(
        t.isin("turn.step.interrupted", "turn.step.retrying"), F.coalesce(_first(("errorMessage",), ("message",), ("reason",)), t)).when(t == "prompt.aborted", F.coalesce(_b("reason"), t)).when(
        t == "agent.turn.ended", _b("outcome")).when(t.isin("turn.ended", "prompt.completed"), _b("reason")).when(t == "llm.request", F.concat_ws("/", _b("provider"), _b("model"))).when(
        t == "usage.record", _b("model")).when(t.isin("turn.prompt", "turn.steer"), F.coalesce(text, _b("origin", "kind"))).when(
        t.isin("runtime.set_binding", "permission.set_mode", "plugin.session_start", "agent.turn.started", "token_counting.measured", "token_counting.turn_recorded"), F.lit(None).cast("string")).otherwise(t)
    wire = F.when(kind == "other", F.coalesce(t, F.lit("unrecognized record"))).otherwise(wire)
    call = F.expr(J.coalesce_sql(J.string_sql("get(_calls, 0)", "name"), J.string_sql("get(_calls, 0)", "function", "name")))
    message = F.coalesce(text, F.when(F.size("_calls") > 0, call), t, F.lit("message"))
    loop = F.when(t == "content.part", F.coalesce(text, F.lit("[unknown content]"))).when(t == "tool.call", F.coalesce(_first(("name",), ("args", "command")), F.lit("unknown"))).when(
        t == "tool.result", F.coalesce(text, F.lit("[empty output]"))).otherwise(F.coalesce(t, F.lit("unknown loop event")))
    warnings = F.expr(f"nullif(array_join(filter(transform(slice(try_variant_get(_b, '$.warnings', 'array<variant>'), 1, {PARTS}), w -> {J.string_sql('w', 'message')}), w -> w IS NOT NULL), ' '), '')")
    journal = F.when(t.isin(*PROMPTS, "context.spliced", "tool.result"), text).when(t == "event.config.warning", warnings).when(t == "hook.result", _b("content")).when(t.isin("assistant.delta", "thinking.delta"), _b("delta")).when(
        t == "turn.step.retrying", _first(("errorMessage",), ("error", "message"), ("prompt",), ("reason",))).when(t.startswith("turn."), _first(("message",), ("error", "message"), ("prompt",), ("reason",))).when(
        t.startswith("prompt."), _b("reason")).when(kind == "session", _first(("session", "title"), ("title",), ("patch", "title"))).when(t.isin("error", "warning"), _b("message")).when(
        t.startswith("tool.call"), _b("name")).when((t == "tool.progress") | t.startswith("shell."), _b("update", "text")).when(kind == "subagent", _first(("resultSummary",), ("description",), ("error",))).when(
        t.startswith("compaction."), _first(("result", "summary"), ("instruction",))).when(t == "cron.fired", _b("prompt")).when(t == "task.notified", _first(("title",), ("body",))).when(
        kind == "task", _b("info", "description")).when(kind == "approval", F.coalesce(F.expr(J.string_sql("try_variant_get(_b, '$.questions[0]', 'variant')", "question")), _first(("action",), ("feedback",)))).when(
        kind == "observation", _first(("server", "name"), ("serverName",)))
    return F.when(form == "journal", F.coalesce(journal, t)).when(form == "message", message).when(form == "loop", loop).when(form == "wire", wire)


def _label() -> Column:
    form, t = F.col("_form"), F.col("_t")
    own = F.when((F.col("_key") == "loop content.part") & (F.col("_kind") == "reasoning"), "Kimi reasoning").when(
        (F.col("_key") == "wire context.apply_compaction") & F.coalesce(_first(("summary",), ("contextSummary",)), F.col("_text")).isNotNull(), "Kimi compaction").when(
        (form == "wire") & ~F.col("_checked") & t.isin(list(CHECKED_KINDS)), "Kimi").when(form == "message", F.concat(F.lit("Kimi "), F.coalesce(F.left(t, F.lit(40)), F.lit("message")))).when(form == "header", "Kimi server journal v1")
    return F.coalesce(own, J.lookup(LABELS, F.col("_key")), F.lit("Kimi"))


def _one_message() -> Column:
    """The only message spliced in, as a variant."""
    return F.expr("if(_key = 'journal context.spliced' AND size(try_variant_get(_b, '$.messages', 'array<variant>')) = 1, try_variant_get(_b, '$.messages[0]', 'variant'), null)")


def _status(path: bool = False) -> Column:
    """Status, or with `path` the place below the record it was read from."""
    t, kind, form = F.col("_t"), F.col("_kind"), F.col("_form")
    def read(*paths: tuple[str, ...]) -> Column:
        if not path:
            return _first(*paths)
        return F.coalesce(*[F.when(_b(*p).isNotNull(), F.concat(F.col("_at"), F.lit("." + ".".join(p)))) for p in paths])
    def told(value, place: str | None = None) -> Column:
        found = value if isinstance(value, Column) else F.lit(value)
        if not path:
            return found
        return F.when(found.isNotNull(), F.concat(F.col("_at"), F.lit(place)) if place else F.when(form == "journal", "$.envelope.type").when(form == "loop", "$.event.type").otherwise("$.type"))
    failed = F.when(form == "loop", F.when(t == "tool.result", _flag("result", "isError"))).when((form == "message") | (form == "journal") & (t.startswith("tool.call") | t.isin("tool.progress", "tool.result") | t.startswith("shell.")), _flag("isError"))
    fail_place = F.when(form == "loop", F.lit("$.event.result.isError")).otherwise(F.concat(F.col("_at"), F.lit(".isError")))
    by_flag = F.when(failed.isNotNull(), fail_place) if path else F.when(failed, "error").when(~failed, "completed")
    fixed = told(F.when((form != "wire") | (kind != "other"), J.lookup(TYPE_STATUS, F.col("_key"))))
    outcome = F.when(_b("outcome") == "done", "completed").otherwise(_b("outcome"))
    suffix = F.when(t.startswith("subagent.") | t.startswith("compaction."), F.substring_index(t, ".", -1))
    wire = F.when((t == "agent.turn.ended") & (kind == "turn"), told(outcome, ".outcome")).when(t.isin("turn.ended", "prompt.completed") & (kind == "turn"), read(("reason",))).when(
        (kind == "task"), F.when(t == "task.started", read(("info", "status"), ("status",))).otherwise(read(("info", "status"))))
    journal = F.when(t.isin(PROMPTS), read(("status",))).when(t == "turn.step.completed", read(("finishReason",))).when(t.startswith("turn.") | t.startswith("prompt."), read(("reason",))).when(
        kind == "session", read(("session", "status"), ("status",), ("last_turn_reason",))).when(kind == "approval", F.coalesce(read(("decision",)), told(F.when(t.endswith(".requested"), "requested").when(t.endswith(".dismissed"), "dismissed").otherwise("resolved")))).when(
        suffix.isNotNull(), told(suffix)).when((kind == "task") & t.rlike("task[.](started|terminated)$"), read(("info", "status"))).when(
        (kind == "observation") & ~t.isin("warning", "event.config.warning", "tool.progress"), read(("server", "status"), ("phase", "kind")))
    return F.coalesce(by_flag, fixed, F.when(form == "wire", wire).when(form == "journal", journal).when((form == "loop") & (t == "step.end"), read(("finishReason",))))


def _columns() -> dict[str, Column]:
    t, kind, form = F.col("_t"), F.col("_kind"), F.col("_form")
    failed = _status(path=True).endswith(".isError") & (_status() == "error")
    said = F.when(t.isin("turn.prompt", "turn.steer"), F.when(_b("origin", "kind") == "user", "user").otherwise("system")).when(t == "prompt.steered", "user").when(t.rlike("^(agent[.])?turn[.]"), "assistant").otherwise("system")
    told = F.when(t.isin(PROMPTS), "user").when(t.startswith("turn.") | t.isin("assistant.delta", "hook.result", "thinking.delta") | t.startswith("tool.call"), "assistant").when(
        t.isin("tool.progress", "tool.result") | t.startswith("shell."), "tool").when(kind == "subagent", "agent").when(kind == "approval", F.when(t.endswith(".requested"), "assistant").otherwise("user")).when(
        _one_message().isNotNull(), actor_from_role(J.let_sql(_one_message(), J.string_sql("m", "role"), "m"))).otherwise("system")
    loops = F.when(t == "tool.result", "tool").when(t.isin(list(LOOP_KINDS)), "assistant")
    number = F.expr(_whole_sql("_b", "turnId", least=0)).cast("bigint").cast("string")
    asked = F.when(kind == "approval", F.expr(_whole_sql("_b", "turn_id", least=0)).cast("bigint").cast("string"))
    turned = (form.isin("journal", "loop")) | (form == "wire") & (kind != "other") & (t.rlike("^(agent[.])?turn[.]") | t.startswith("token_counting."))
    only_call = F.expr(f"if(size(_calls) = 1, {J.string_sql('get(_calls, 0)', 'id')}, null)")
    stamp = F.expr(J.string_sql("value", "envelope", "timestamp"))
    ms = F.when(stamp.rlike(r"^\d{4}-\d\d") & (F.length(stamp) <= 64), text_to_ms(stamp)).cast("bigint")
    iso = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    counters = F.when(form.isin("message", "loop", "journal") | _key("wire usage.record") & (kind != "other"), _usage(J.get_sql("_b", "usage")))
    watched = F.when((form == "journal") & (kind == "observation"), _usage(J.get_sql("_b", "usage", "currentTurn")))
    trouble = (form == "journal") & t.startswith("turn.") & ((_b("reason") == "failed") | F.expr(_has("_b", "OBJECT", "error")))
    severity = F.when(failed, "error").when(t.isin("turn.step.retrying", "warning", "event.config.warning") & (kind != "other"), "warning").when(_key("journal error", "journal subagent.failed") | F.coalesce(trouble, F.lit(False)), "error").when(
        _key("journal task.notified"), _b("severity"))
    tool = F.when(form == "message", F.expr(J.coalesce_sql(J.string_sql("get(_calls, 0)", "name"), J.string_sql("get(_calls, 0)", "function", "name")))).when(_key("loop tool.call") | (form == "journal") & t.startswith("tool."), _b("name"))
    command = F.when(_key("loop tool.call"), _first(("command",), ("display", "command"), ("args", "command"))).when((form == "journal") & t.startswith("tool."), _first(("display", "command"), ("args", "command")))
    ids = {"session_id": F.when(form == "journal", F.coalesce(F.expr(J.string_sql("value", "envelope", "session_id")), _b("sessionId"))),
           "turn_id": F.when(turned, F.coalesce(_b("turnId"), number, F.when(form == "journal", asked))),
           "message_id": F.when(form == "message", _b("id")).when(_key("loop content.part", "loop tool.call"), _b("uuid")).when(_key("loop step.begin", "loop step.end"), _b("messageId")).when(
               (form == "journal") & (t.startswith("prompt.") | (t == "turn.steer")), _first(("userMessageId",), ("messageId",))).when(form == "journal", J.let_sql(_one_message(), J.string_sql("m", "id"), "m")),
           "tool_call_id": F.when(form == "message", F.coalesce(only_call, _b("toolCallId"))).when(form == "loop", _b("toolCallId")).when(form == "journal", F.coalesce(_b("toolCallId"), F.when(kind == "approval", _b("tool_call_id")))),
           "parent_id": F.when(_key("loop tool.result"), _b("parentUuid")), "subagent_id": F.when((form == "journal") & (kind == "subagent"), _b("subagentId"))}
    omitted = F.greatest(*[F.coalesce(F.length(c) > IDENTITY, F.lit(False)) for c in ids.values()])
    def short(c: Column) -> Column:
        return F.left(c, F.lit(TEXT)).cast("variant")
    return {
        "event_kind": kind, **{k: _id(c) for k, c in ids.items()},
        "timestamp_raw": F.when(form == "journal", iso).when(form == "header", _instant("value", "created_at")).otherwise(F.coalesce(_instant("value", "time"), F.when(_key("wire metadata"), _instant("value", "created_at")))),
        "actor": F.when(form == "journal", told).when(form == "header", "system").when(form == "message", actor_from_role(t)).when(form == "loop", loops).when(kind != "other", said),
        "model": F.when((form == "journal") & (kind == "observation"), F.left(_b("model"), F.lit(TEXT))), "status": F.left(_status(), F.lit(TEXT)), "severity": severity, "usage": F.coalesce(counters, watched),
        "summary": J.collapse(F.concat_ws(": ", _label(), _detail())), "confidence": F.when(kind != "other", "source").otherwise("inferred"),
        "derived": derived(
            agentId=short(F.expr(f"if(_form = 'journal', {J.string_sql('_b', 'agentId')}, {J.string_sql('value', 'agentId')})")), toolName=short(tool), toolCommand=short(command),
            stepUuid=short(F.when(_key("loop step.begin", "loop step.end"), _b("uuid")).when(form == "loop", _b("stepUuid"))), stepId=short(F.when(form.isin("journal", "wire"), _b("stepId"))),
            step=F.when(form.isin("journal", "loop"), F.expr(J.number_sql("_b", "step"))).cast("variant"), promptId=short(F.when(form.isin("journal", "wire"), _b("promptId"))),
            origin=short(_b("origin", "kind")), serverName=short(_first(("server", "name"), ("serverName",))), reason=short(F.when(form.isin("journal", "wire"), _b("reason"))),
            protocolVersion=short(F.when(_key("wire metadata"), _b("protocol_version"))), journalVersion=F.when(form == "header", F.expr(J.number_sql("value", "version"))).cast("variant"),
            toolCallCount=F.when((form == "message") & (F.size("_calls") > 0), F.size("_calls")).cast("variant"), identityOmitted=F.when(omitted, True).cast("variant")),
    }


def _signals() -> dict[str, Column]:
    identified = _b("agentId").isNotNull() & _b("sessionId").isNotNull()
    told = F.when(F.col("_t") == "error", _b("code").isNotNull() & _b("message").isNotNull() & _flag("retryable").isNotNull()).when(F.col("_t") == "warning", _b("message").isNotNull()).otherwise(True)
    event = (F.col("_form") == "journal") & F.col("_t").isin(list(JOURNAL_KINDS)) & identified & told
    no = F.lit(False)
    return {"journal_headers": F.col("_header"), "journal_events": F.coalesce(event, no), "specific": F.coalesce(event & ~F.col("_t").isin("error", "warning"), no),
            "headers": F.coalesce(F.col("_checked") & (F.col("_t") == "metadata"), no), "records": F.coalesce(F.col("_checked") & (F.col("_wt") != "metadata"), no)}


def _varied() -> dict[str, Column]:
    signals = _signals()
    return {"record_types": F.when(signals["records"], F.concat_ws("/", "_wt", F.when(F.col("_form") == "loop", F.col("_t")))), "event_types": F.when(signals["journal_events"], F.col("_t"))}


def _score(s, n):
    covered = (s["headers"] + s["records"] + s["journal_headers"] + s["journal_events"]) / n
    backed = (s["headers"] > 0) & (s["records"] > 0) | (s["records"] >= 3) & s["record_types"] | (s["journal_headers"] > 0) & (s["journal_events"] > 0) | (s["journal_events"] >= 3) & s["event_types"] & (s["specific"] > 0)
    met = F.coalesce(backed, F.lit(False)) & (covered >= 0.6)
    headed = F.when(s["headers"] + s["journal_headers"] > 0, 0.08).otherwise(0.0)
    return F.when(met, F.least(F.lit(0.99), 0.78 + 0.12 * covered + headed)).otherwise(F.least(F.lit(0.6), covered * 0.6)), met


def _evidence() -> dict[str, Column]:
    """Paths below the object a form is read from."""
    form, kind = F.col("_form"), F.col("_kind")
    def below(*names: str) -> Column:
        return F.coalesce(*[F.when(F.expr(J.get_sql("_b", n)).isNotNull(), F.concat(F.col("_at"), F.lit(f".{n}"))) for n in names])
    typed = F.when(form == "journal", F.lit("$.envelope.type")).when(form == "header", F.lit("$.kind")).when(form == "message", F.concat(F.col("_at"), F.lit(".role"))).when(
        F.col("_key") == "loop content.part", F.lit("$.event.part.type")).when(form == "loop", F.lit("$.event.type")).otherwise(F.when(F.col("_wt").isNotNull(), F.lit("$.type")))
    session = F.when(F.expr(J.string_sql("value", "envelope", "session_id")).isNotNull(), F.lit("$.envelope.session_id")).otherwise(below("sessionId"))
    call = F.when((form == "message") & F.expr(f"size(_calls) = 1 AND {J.string_sql('get(_calls, 0)', 'id')} IS NOT NULL"), F.concat(F.col("_at"), F.lit(".toolCalls[0].id"))).otherwise(below("toolCallId", "tool_call_id"))
    stamp = F.when(form == "journal", F.lit("$.envelope.timestamp")).when(F.expr(_whole("value", "time", least=0)), F.lit("$.time")).otherwise(F.lit("$.created_at"))
    spliced = F.when(F.col("_key") == "journal context.spliced", F.lit("$.envelope.payload.messages[0].id"))
    message = F.coalesce(spliced, F.when(form == "message", below("id")).when(F.col("_key").isin("loop step.begin", "loop step.end"), below("messageId")).when(form == "loop", below("uuid")).otherwise(below("userMessageId", "messageId")))
    used = F.when((form == "journal") & (kind == "observation") & F.expr(_has("_b", "OBJECT", "usage", "currentTurn")), F.lit("$.envelope.payload.usage.currentTurn")).otherwise(below("usage"))
    return {"event_kind": typed, "timestamp_raw": stamp, "session_id": session, "turn_id": below("turnId", "turn_id"), "message_id": message, "tool_call_id": call,
            "parent_id": below("parentUuid"), "subagent_id": below("subagentId"), "status": _status(path=True), "usage": used}


SESSION_WIRE = Profile("kimi-code-session", "5", _columns, _signals, _score, _prepare, _evidence, _varied, _screen)
