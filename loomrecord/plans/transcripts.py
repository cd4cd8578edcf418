"""Queries over transcript records derived from conversations: normalisers, detection, trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.operators import trajectory as T
from loomrecord.operators.conversation import conversation_walk
from loomrecord.operators.records import parse_texts
from loomrecord.plans.corpora import log_records
from loomrecord.plans.registry import query, table
from loomrecord.session import spread
from loomrecord.plans.relations import agent_records
from loomrecord.plans.telemetry import parsed as otel_parsed
from loomrecord.profiles import registry as P
from loomrecord.profiles.engineering import ENGINEERING
from loomrecord.profiles import transcripts as N
from loomrecord.profiles import wires as W


def build(spark, sf, source: str, sql: str):
    c = spread(table(spark, sf, "conversations")).withColumns({"c": F.expr("'c' || conv_id"), "iso": F.expr("date_format(timestamp_seconds(1700000000 + conv_id * 60 + turn), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")")})
    return parse_texts(c.select(F.lit(source).alias("source_id"), F.expr("conv_id * 10 + turn").alias("ordinal"), F.expr(sql).alias("text")))


def transcript_records(spark, sf):
    return build(spark, sf, "transcript", """CASE
      WHEN role = 'system' THEN to_json(named_struct('type', 'system', 'subtype', if(conv_id % 2 = 0, 'error', 'init'), 'sessionId', c, 'uuid', c || turn, 'timestamp', iso, 'content', text))
      WHEN turn % 4 = 1 THEN to_json(named_struct('type', 'assistant', 'sessionId', c, 'uuid', c || turn, 'parentUuid', c || (turn - 1), 'timestamp', iso, 'message', named_struct('role', 'assistant', 'model', 'm1', 'content',
        array(named_struct('type', 'text', 'text', text, 'id', null, 'name', null), named_struct('type', 'tool_use', 'text', null, 'id', c || '-k' || turn, 'name', 'grep')), 'usage', named_struct('input_tokens', length(text), 'output_tokens', turn))))
      WHEN turn % 4 = 2 THEN to_json(named_struct('type', 'user', 'sessionId', c, 'uuid', c || turn, 'timestamp', iso, 'message', named_struct('role', 'user', 'content', array(named_struct('type', 'tool_result', 'tool_use_id', c || '-k' || (turn - 1),
        'content', text, 'is_error', if(conv_id % 3 = 0, null, conv_id % 3 = 1))))))
      ELSE to_json(named_struct('type', role, 'sessionId', c, 'uuid', c || turn, 'timestamp', iso, 'message', named_struct('role', role, 'content', text))) END""")


TS = """ts AS (SELECT conv_id * 10 + turn AS ordinal, conv_id, turn, role, text, 'c' || conv_id AS c,
  CASE WHEN role = 'system' THEN CASE WHEN conv_id % 2 = 0 THEN 'error' ELSE 'checkpoint' END WHEN turn % 4 = 1 THEN 'tool_call' WHEN turn % 4 = 2 THEN 'tool_result' ELSE 'message' END AS event_kind,
  CASE WHEN role = 'system' THEN 'system' WHEN turn % 4 = 1 THEN 'assistant' WHEN turn % 4 = 2 THEN 'tool' ELSE role END AS actor,
  CASE WHEN role <> 'system' AND turn % 4 = 2 AND conv_id % 3 <> 0 THEN conv_id % 3 = 1 END AS has_error FROM conversations)"""


@query("n07_transcript", f"""WITH {TS} SELECT ordinal, event_kind, actor, c AS session_id, c || turn AS message_id, CASE WHEN event_kind = 'tool_call' THEN c || (turn - 1) END AS parent_id,
  CASE event_kind WHEN 'tool_call' THEN c || '-k' || turn WHEN 'tool_result' THEN c || '-k' || (turn - 1) END AS tool_call_id, CASE WHEN event_kind = 'tool_call' THEN length(text) END::DOUBLE AS usage_input,
  CASE WHEN event_kind = 'error' THEN 'error' END AS severity FROM ts""")
def n07(spark, sf):
    return N.TRANSCRIPT.project(transcript_records(spark, sf)).select("ordinal", "event_kind", "actor", "session_id", "message_id", "parent_id", "tool_call_id", F.col("usage.input").alias("usage_input"), "severity")


def rollout_records(spark, sf):
    return build(spark, sf, "rollout", """to_json(named_struct('timestamp', iso, 'type', CASE turn WHEN 0 THEN 'session_meta' WHEN 5 THEN 'event_msg' WHEN 6 THEN 'event_msg' ELSE 'response_item' END, 'payload', CASE turn
      WHEN 0 THEN named_struct('type', null, 'id', c, 'role', null, 'call_id', null, 'name', null, 'content', null, 'arguments', null, 'output', null, 'message', null, 'turn_id', null, 'info', null)
      WHEN 2 THEN named_struct('type', 'function_call', 'id', null, 'role', null, 'call_id', c || '-k', 'name', 'ls', 'content', null, 'arguments', text, 'output', null, 'message', null, 'turn_id', c || '-t', 'info', null)
      WHEN 3 THEN named_struct('type', 'function_call_output', 'id', null, 'role', null, 'call_id', c || '-k', 'name', null, 'content', null, 'arguments', null, 'output', text, 'message', null, 'turn_id', c || '-t', 'info', null)
      WHEN 5 THEN named_struct('type', 'token_count', 'id', null, 'role', null, 'call_id', null, 'name', null, 'content', null, 'arguments', null, 'output', null, 'message', null, 'turn_id', null, 'info', named_struct('total_token_usage', named_struct('input_tokens', length(text))))
      WHEN 6 THEN named_struct('type', 'error', 'id', null, 'role', null, 'call_id', null, 'name', null, 'content', null, 'arguments', null, 'output', null, 'message', text, 'turn_id', null, 'info', null)
      ELSE named_struct('type', 'message', 'id', c || '-m' || turn, 'role', role, 'call_id', null, 'name', null, 'content', array(named_struct('type', 'input_text', 'text', text)), 'arguments', null, 'output', null, 'message', null, 'turn_id', c || '-t', 'info', null) END))""")


@query("n02_rollout", """SELECT conv_id * 10 + turn AS ordinal, CASE turn WHEN 0 THEN 'session' WHEN 2 THEN 'tool_call' WHEN 3 THEN 'tool_result' WHEN 5 THEN 'usage' WHEN 6 THEN 'error' ELSE 'message' END AS event_kind,
  CASE turn WHEN 0 THEN 'system' WHEN 2 THEN 'assistant' WHEN 3 THEN 'tool' WHEN 5 THEN 'system' WHEN 6 THEN 'system' ELSE role END AS actor, CASE WHEN turn = 0 THEN 'c' || conv_id END AS session_id,
  CASE WHEN turn IN (2, 3) THEN 'c' || conv_id || '-k' END AS tool_call_id, CASE WHEN turn IN (1, 4, 7) THEN 'c' || conv_id || '-m' || turn END AS message_id, CASE WHEN turn = 5 THEN length(text) END::DOUBLE AS usage_input, CASE WHEN turn = 6 THEN 'error' END AS severity FROM conversations""")
def n02(spark, sf):
    return N.ROLLOUT.project(rollout_records(spark, sf)).select("ordinal", "event_kind", "actor", "session_id", "tool_call_id", "message_id", F.col("usage.input").alias("usage_input"), "severity")


def exec_records(spark, sf):
    return build(spark, sf, "exec", """CASE turn WHEN 0 THEN to_json(named_struct('type', 'thread.started', 'thread_id', c)) WHEN 1 THEN '{"type":"turn.started"}'
      WHEN 2 THEN to_json(named_struct('type', 'item.started', 'item', named_struct('id', 'i1', 'type', 'command_execution', 'command', text)))
      WHEN 3 THEN to_json(named_struct('type', 'item.completed', 'item', named_struct('id', 'i1', 'type', 'CommandExecution', 'status', 'completed', 'exit_code', conv_id % 2)))
      WHEN 4 THEN to_json(named_struct('type', 'item.completed', 'item', named_struct('id', 'i2', 'type', 'agent-message', 'text', text)))
      WHEN 5 THEN to_json(named_struct('type', 'turn.completed', 'usage', named_struct('input_tokens', length(text)))) ELSE to_json(named_struct('type', 'turn.failed', 'error', named_struct('message', text))) END""")


@query("n03_exec", """SELECT conv_id * 10 + turn AS ordinal, CASE turn WHEN 0 THEN 'session' WHEN 1 THEN 'turn' WHEN 2 THEN 'tool_call' WHEN 3 THEN 'tool_result' WHEN 4 THEN 'message' WHEN 5 THEN 'result' ELSE 'error' END AS event_kind,
  CASE turn WHEN 0 THEN 'system' WHEN 3 THEN 'tool' WHEN 6 THEN 'system' WHEN 7 THEN 'system' ELSE 'assistant' END AS actor, CASE WHEN turn = 0 THEN 'c' || conv_id END AS session_id, CASE WHEN turn IN (2, 3) THEN 'i1' END AS tool_call_id,
  CASE WHEN turn = 3 THEN 'completed' WHEN turn > 5 THEN 'failed' END AS status, CASE WHEN turn = 5 THEN length(text) END::DOUBLE AS usage_input FROM conversations""")
def n03(spark, sf):
    return N.EXEC.project(exec_records(spark, sf)).select("ordinal", "event_kind", "actor", "session_id", "tool_call_id", "status", F.col("usage.input").alias("usage_input"))


def trace_records(spark, sf):
    return build(spark, sf, "trace", "to_json(named_struct('seq', turn, 'wall_time_unix_ms', 1700000000000 + turn, 'rollout_id', 'r', 'thread_id', c, 'payload', named_struct('type', element_at(array('rollout_started', 'codex_turn_started', 'tool_call_started', 'tool_call_ended', 'inference_failed', 'code_cell_started', 'agent_result_observed', 'strange'), int(turn) + 1))))")


@query("n04_trace", """SELECT conv_id * 10 + turn AS ordinal, list_extract(['session', 'turn', 'tool_call', 'tool_result', 'error', 'action', 'subagent', 'other'], CAST(turn + 1 AS INT)) AS event_kind, 'c' || conv_id AS session_id,
  1700000000000 + turn AS ms FROM conversations""")
def n04(spark, sf):
    return N.TRACE.project(trace_records(spark, sf)).select("ordinal", "event_kind", "session_id", F.unix_millis("ts").alias("ms"))


@query("n05_history", "SELECT conv_id * 10 + turn AS ordinal, CASE WHEN turn = 3 THEN 'other' ELSE 'message' END AS event_kind, CASE WHEN turn <> 3 THEN 'c' || conv_id END AS session_id, CASE WHEN turn <> 3 THEN (1700000000 + turn) * 1000 END AS ms FROM conversations")
def n05(spark, sf):
    recs = build(spark, sf, "history", "to_json(named_struct('session_id', c, 'ts', if(turn = 3, null, 1700000000 + turn), 'text', text))")
    return N.HISTORY.project(recs).select("ordinal", "event_kind", "session_id", F.unix_millis("ts").alias("ms"))


@query("n06_session_index", "SELECT conv_id * 10 + turn AS ordinal, 'session' AS event_kind, 'c' || conv_id AS session_id, CASE WHEN turn % 2 = 1 THEN (1700000000 + conv_id * 60 + turn) * 1000 END AS ms, CASE WHEN turn % 2 = 0 THEN 'unknown' END AS raw FROM conversations")
def n06(spark, sf):
    recs = build(spark, sf, "index", "to_json(named_struct('id', c, 'thread_name', text, 'updated_at', if(turn % 2 = 0, 'unknown', iso)))")
    return N.SESSION_INDEX.project(recs).select("ordinal", "event_kind", "session_id", F.unix_millis("ts").alias("ms"), J.as_string(F.element_at("derived", "timestampRaw")).alias("raw"))


def pi_records(spark, sf):
    return build(spark, sf, "pi", """CASE WHEN turn = 0 THEN to_json(named_struct('type', 'session', 'id', c, 'timestamp', iso, 'cwd', '/w')) WHEN turn = 1 THEN to_json(named_struct('type', 'model_change', 'id', c || 'x', 'timestamp', iso, 'modelId', 'm2'))
      WHEN turn = 2 THEN to_json(named_struct('type', 'message', 'id', c || turn, 'parentId', c || 'x', 'timestamp', iso, 'message', named_struct('role', 'assistant', 'content', array(named_struct('type', 'toolCall', 'id', c || 'k', 'name', 'ls')))))
      WHEN turn = 3 THEN to_json(named_struct('type', 'message', 'id', c || turn, 'timestamp', iso, 'message', named_struct('role', 'toolResult', 'toolCallId', c || 'k', 'isError', conv_id % 2 = 0, 'content', array(named_struct('type', 'text', 'text', text)))))
      ELSE to_json(named_struct('type', 'message', 'id', c || turn, 'timestamp', iso, 'message', named_struct('role', role, 'content', text))) END""")


@query("n08_typed_session", """SELECT conv_id * 10 + turn AS ordinal, CASE turn WHEN 0 THEN 'session' WHEN 1 THEN 'checkpoint' WHEN 2 THEN 'tool_call' WHEN 3 THEN 'tool_result' ELSE 'message' END AS event_kind,
  CASE WHEN turn IN (2, 3) THEN 'c' || conv_id || 'k' END AS tool_call_id, CASE WHEN turn = 3 THEN CASE WHEN conv_id % 2 = 0 THEN 'error' ELSE 'success' END END AS status, CASE WHEN turn > 1 THEN 'c' || conv_id || turn END AS message_id FROM conversations""")
def n08(spark, sf):
    return N.PI.project(pi_records(spark, sf)).select("ordinal", "event_kind", "tool_call_id", "status", "message_id")


def wire_records(spark, sf):
    return build(spark, sf, "wire", """CASE turn WHEN 0 THEN to_json(named_struct('type', 'metadata', 'protocol_version', '1.5', 'created_at', 1700000000000 + conv_id))
      WHEN 2 THEN to_json(named_struct('type', 'context.append_loop_event', 'time', 1700000000000 + conv_id * 1000 + turn, 'agentId', 'main', 'event', named_struct('type', 'tool.call', 'uuid', c || '-u', 'stepUuid', c || '-s', 'turnId', 0, 'toolCallId', c || '-k', 'name', 'ls', 'args', named_struct('command', text))))
      WHEN 3 THEN to_json(named_struct('type', 'context.append_loop_event', 'time', 1700000000000 + conv_id * 1000 + turn, 'event', named_struct('type', 'tool.result', 'toolCallId', c || '-k', 'parentUuid', c || '-u', 'result', named_struct('output', text, 'isError', if(conv_id % 3 = 0, null, conv_id % 3 = 1)))))
      WHEN 4 THEN to_json(named_struct('type', 'context.append_loop_event', 'event', named_struct('type', 'step.end', 'uuid', c || '-s', 'finishReason', 'completed', 'usage', named_struct('inputOther', length(text), 'inputCacheRead', turn, 'inputCacheCreation', if(conv_id % 2 = 0, 1, null), 'output', 7))))
      WHEN 5 THEN to_json(named_struct('type', 'turn.ended', 'agentId', 'main', 'turnId', conv_id, 'reason', if(conv_id % 2 = 0, 'completed', 'lost')))
      ELSE to_json(named_struct('type', 'context.append_message', 'message', named_struct('id', c || '-m' || turn, 'role', role, 'content', array(named_struct('type', 'text', 'text', text)), 'toolCalls', array()))) END""")


@query("n09_wire", """WITH w AS (SELECT *, conv_id * 10 + turn AS ordinal, 'c' || conv_id AS c FROM conversations)
  SELECT ordinal, CASE turn WHEN 0 THEN 'session' WHEN 2 THEN 'tool_call' WHEN 3 THEN 'tool_result' WHEN 4 THEN 'turn' WHEN 5 THEN CASE WHEN conv_id % 2 = 0 THEN 'turn' ELSE 'other' END WHEN 1 THEN 'message' ELSE CASE WHEN role = 'tool' THEN 'tool_result' ELSE 'message' END END AS event_kind,
    CASE WHEN turn = 0 THEN 'system' WHEN turn IN (2, 4) THEN 'assistant' WHEN turn = 3 THEN 'tool' WHEN turn = 5 THEN CASE WHEN conv_id % 2 = 0 THEN 'assistant' END ELSE role END AS actor,
    CASE WHEN turn IN (2, 3) THEN c || '-k' END AS tool_call_id, CASE turn WHEN 2 THEN c || '-u' WHEN 1 THEN c || '-m1' ELSE CASE WHEN turn > 5 THEN c || '-m' || turn END END AS message_id, CASE WHEN turn = 3 THEN c || '-u' END AS parent_id,
    CASE WHEN turn = 3 AND conv_id % 3 <> 0 THEN CASE WHEN conv_id % 3 = 1 THEN 'error' ELSE 'completed' END WHEN turn = 4 OR turn = 5 AND conv_id % 2 = 0 THEN 'completed' END AS status,
    CASE WHEN turn = 2 THEN '0' WHEN turn = 5 AND conv_id % 2 = 0 THEN CAST(conv_id AS VARCHAR) END AS turn_id, CASE WHEN turn = 4 AND conv_id % 2 = 0 THEN length(text) + 5 END::DOUBLE AS usage_input, CASE WHEN turn = 4 THEN 4 END::DOUBLE AS usage_cached,
    CASE WHEN turn = 0 THEN 1700000000000 + conv_id WHEN turn IN (2, 3) THEN 1700000000000 + conv_id * 1000 + turn END AS ms, CASE WHEN turn = 3 AND conv_id % 3 <> 0 THEN conv_id % 3 = 1 END AS has_error FROM w""")
def n09_wire(spark, sf):
    events = W.SESSION_WIRE.project(wire_records(spark, sf), keep=("source_id", "ordinal", "value"))
    return events.select("ordinal", "event_kind", "actor", "tool_call_id", "message_id", "parent_id", "status", "turn_id", F.col("usage.input").alias("usage_input"), F.col("usage.cached").alias("usage_cached"),
                         F.unix_millis("ts").alias("ms"), T.has_error(F.concat_ws("@", "profile_id", "profile_version"), F.col("value")).alias("has_error"))


def journal_records(spark, sf):
    return build(spark, sf, "journal", """if(turn = 0, to_json(named_struct('kind', 'journal_header', 'version', 1, 'epoch', c, 'created_at', 1700000000000)), to_json(named_struct('kind', 'event', 'seq', turn,
      'envelope', named_struct('type', element_at(array('prompt.submitted', 'turn.started', 'tool.call.started', 'tool.result', 'context.spliced', 'subagent.failed', 'strange.event'), int(turn)), 'seq', if(conv_id % 5 = 0 AND turn = 2, 9, turn), 'timestamp', iso,
      'payload', named_struct('agentId', 'main', 'sessionId', c, 'turnId', if(turn = 2, conv_id, null), 'content', if(turn = 1, array(named_struct('type', 'text', 'text', 'say')), null), 'userMessageId', if(turn = 1, c || '-m', null),
        'toolCallId', if(turn in (3, 4), c || '-k', null), 'output', if(turn = 4, text, null), 'isError', if(turn = 4, conv_id % 2 = 0, null), 'messages', if(turn = 5 AND conv_id % 2 = 0, array(named_struct('id', 'x', 'role', role, 'content', 'reply')), null),
        'subagentId', if(turn = 6, c || '-a', null))))))""")


@query("n09_journal", """WITH w AS (SELECT *, conv_id * 10 + turn AS ordinal, 'c' || conv_id AS c, conv_id % 5 = 0 AND turn = 2 AS odd FROM conversations)
  SELECT ordinal, CASE turn WHEN 0 THEN 'session' WHEN 1 THEN 'message' WHEN 2 THEN CASE WHEN odd THEN 'other' ELSE 'turn' END WHEN 3 THEN 'tool_call' WHEN 4 THEN 'tool_result' WHEN 5 THEN CASE WHEN conv_id % 2 = 0 THEN 'message' ELSE 'checkpoint' END WHEN 6 THEN 'subagent' ELSE 'other' END AS event_kind,
    CASE WHEN turn = 0 OR turn = 7 THEN 'system' WHEN turn = 1 THEN 'user' WHEN turn = 2 THEN CASE WHEN NOT odd THEN 'assistant' END WHEN turn = 3 THEN 'assistant' WHEN turn = 4 THEN 'tool' WHEN turn = 5 THEN CASE WHEN conv_id % 2 = 0 THEN role ELSE 'system' END ELSE 'agent' END AS actor,
    CASE WHEN turn > 0 AND NOT odd THEN c END AS session_id, CASE WHEN turn = 2 AND NOT odd THEN CAST(conv_id AS VARCHAR) END AS turn_id, CASE WHEN turn IN (3, 4) THEN c || '-k' END AS tool_call_id,
    CASE WHEN turn = 1 THEN c || '-m' WHEN turn = 5 AND conv_id % 2 = 0 THEN 'x' END AS message_id, CASE WHEN turn = 6 THEN c || '-a' END AS subagent_id,
    CASE WHEN turn = 2 AND NOT odd THEN 'running' WHEN turn = 4 THEN CASE WHEN conv_id % 2 = 0 THEN 'error' ELSE 'completed' END WHEN turn = 6 THEN 'failed' END AS status, CASE WHEN turn = 4 AND conv_id % 2 = 0 OR turn = 6 THEN 'error' END AS severity,
    CASE WHEN turn = 0 THEN 1700000000000 WHEN NOT odd THEN (1700000000 + conv_id * 60 + turn) * 1000 END AS ms FROM w""")
def n09_journal(spark, sf):
    return W.SESSION_WIRE.project(journal_records(spark, sf)).select("ordinal", "event_kind", "actor", "session_id", "turn_id", "tool_call_id", "message_id", "subagent_id", "status", "severity", F.unix_millis("ts").alias("ms"))


def engineering_records(spark, sf):
    return build(spark, sf, "engineering", """to_json(CASE turn
      WHEN 0 THEN named_struct('instance_id', c, 'problem_statement', text, 'step', null, 'parent_step', null, 'tool', null, 'action', null, 'observation', null, 'patch', null, 'test_result', null, 'outcome', null, 'timestamp', iso)
      WHEN 1 THEN named_struct('instance_id', c, 'problem_statement', null, 'step', 1, 'parent_step', null, 'tool', 'grep', 'action', named_struct('command', 'x' || conv_id), 'observation', null, 'patch', null, 'test_result', null, 'outcome', null, 'timestamp', iso)
      WHEN 2 THEN named_struct('instance_id', c, 'problem_statement', null, 'step', 2, 'parent_step', 1, 'tool', null, 'action', null, 'observation', lang, 'patch', null, 'test_result', null, 'outcome', null, 'timestamp', iso)
      WHEN 3 THEN named_struct('instance_id', c, 'problem_statement', null, 'step', 3, 'parent_step', null, 'tool', null, 'action', null, 'observation', null, 'patch', 'diff', 'test_result', null, 'outcome', null, 'timestamp', iso)
      WHEN 4 THEN named_struct('instance_id', c, 'problem_statement', null, 'step', null, 'parent_step', null, 'tool', null, 'action', null, 'observation', null, 'patch', null, 'test_result', if(conv_id % 2 = 0, '3 passed', 'timeout after 1'), 'outcome', null, 'timestamp', iso)
      WHEN 5 THEN named_struct('instance_id', c, 'problem_statement', null, 'step', 5, 'parent_step', null, 'tool', null, 'action', null, 'observation', null, 'patch', null, 'test_result', null, 'outcome', if(conv_id % 3 = 0, 'failed', 'resolved'), 'timestamp', iso)
      ELSE named_struct('instance_id', null, 'problem_statement', null, 'step', turn, 'parent_step', null, 'tool', null, 'action', null, 'observation', null, 'patch', null, 'test_result', null, 'outcome', null, 'timestamp', iso) END)""".replace("lang", "'seen ' || conv_id"))


@query("n12_engineering", """WITH w AS (SELECT *, conv_id * 10 + turn AS ordinal, 'c' || conv_id AS c FROM conversations), k AS (SELECT *, CASE turn WHEN 0 THEN 'task' WHEN 1 THEN 'action' WHEN 2 THEN 'observation' WHEN 3 THEN 'patch'
    WHEN 4 THEN CASE WHEN conv_id % 2 = 0 THEN 'test' ELSE 'error' END WHEN 5 THEN CASE WHEN conv_id % 3 = 0 THEN 'error' ELSE 'result' END ELSE 'turn' END AS event_kind, CASE WHEN turn IN (1, 2, 3) OR turn > 4 THEN CAST(turn AS VARCHAR) END AS step FROM w)
  SELECT ordinal, event_kind, CASE WHEN event_kind IN ('observation', 'test', 'result', 'error') THEN 'tool' WHEN event_kind IN ('action', 'turn', 'patch') THEN 'agent' ELSE 'system' END AS actor, CASE WHEN turn < 6 THEN c END AS session_id, step AS turn_id,
    CASE WHEN event_kind NOT IN ('observation', 'result', 'test') THEN step END AS message_id, CASE WHEN turn = 2 THEN '1' END AS parent_id, CASE WHEN turn IN (1, 2) THEN step END AS tool_call_id,
    CASE WHEN turn = 5 THEN CASE WHEN conv_id % 3 = 0 THEN 'failed' ELSE 'resolved' END END AS status, CASE WHEN event_kind = 'error' THEN 'error' END AS severity,
    CASE turn WHEN 1 THEN 'Tool grep: {command}' WHEN 2 THEN 'Observation: seen ' || conv_id WHEN 3 THEN 'Patch: diff' END AS summary, (1700000000 + conv_id * 60 + turn) * 1000 AS ms FROM k""")
def n12(spark, sf):
    e = ENGINEERING.project(engineering_records(spark, sf))
    return e.select("ordinal", "event_kind", "actor", "session_id", "turn_id", "message_id", "parent_id", "tool_call_id", "status", "severity",
                    F.when(F.col("event_kind").isin("action", "observation", "patch"), F.col("summary")).alias("summary"), F.unix_millis("ts").alias("ms"))


@query("a19_detect_profile", """SELECT unnest(['agent-log', 'app-log', 'engineering', 'exec', 'journal', 'otel', 'rollout', 'trace', 'transcript', 'wire']) AS source_id, unnest(['generic-agent-events', 'structured-application-log', 'software-engineering-agent', 'codex-exec-jsonl', 'kimi-code-session', 'opentelemetry', 'codex-rollout', 'codex-trace', 'claude-code-session', 'kimi-code-session']) AS profile_id
  FROM (SELECT count(*) FROM conversations)""")
def a19(spark, sf):
    parts = [parse_texts(agent_records(spark, sf)), log_records(spark, sf), exec_records(spark, sf), otel_parsed(spark, sf), rollout_records(spark, sf), trace_records(spark, sf), transcript_records(spark, sf), wire_records(spark, sf), journal_records(spark, sf), engineering_records(spark, sf)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    from loomrecord.session import materialize

    return P.detect(materialize(every.select("source_id", "value"), "mixed")).select("source_id", "profile_id")


@query("e02_conversation_parts", f"""WITH {TS} SELECT ordinal, CASE WHEN role = 'system' THEN 'unknown' WHEN turn % 4 = 1 THEN 'assistant' WHEN turn % 4 = 2 THEN 'user' ELSE role END AS role,
  CASE WHEN role = 'system' THEN '$.content' WHEN turn % 4 IN (1, 2) THEN '$.message[0]' ELSE '$.message' END AS path, substr(text, 1, 2048) AS text FROM ts""")
def e02(spark, sf):
    parts = transcript_records(spark, sf).select("ordinal", F.explode(T.conversation_parts(F.col("value"))["parts"]).alias("p"))
    return parts.select("ordinal", "p.role", "p.path", "p.text")


@query("e02_conversation_walk", f"""WITH {TS} SELECT ordinal, CASE WHEN role = 'system' THEN 'unknown' WHEN turn % 4 = 1 THEN 'assistant' WHEN turn % 4 = 2 THEN 'user' ELSE role END AS role, 'Record' AS label,
  CASE WHEN role = 'system' THEN '$.content' WHEN turn % 4 = 1 THEN '$.message.content[0].text' WHEN turn % 4 = 2 THEN '$.message.content[0].content' ELSE '$.message.content' END AS path, text FROM ts WHERE text <> ''""")
def e02_walk(spark, sf):
    parts = transcript_records(spark, sf).select("ordinal", F.inline(conversation_walk(F.col("value"))["parts"]))
    return parts.select("ordinal", "role", "label", "path", "text")


def trajectory(spark, sf):
    return T.project(N.TRANSCRIPT.project(transcript_records(spark, sf), keep=("source_id", "ordinal", "value")))


@query("t01_trajectory", f"WITH {TS} SELECT ordinal, actor, text FROM ts")
def t01(spark, sf):
    return trajectory(spark, sf).select("ordinal", "actor", "text")


@query("t02_has_error", f"WITH {TS} SELECT ordinal, has_error FROM ts")
def t02(spark, sf):
    return trajectory(spark, sf).select("ordinal", "has_error")


@query("t03_trajectory_slice", f"WITH {TS} SELECT ordinal, text FROM ts WHERE actor = 'tool' AND has_error")
def t03(spark, sf):
    return T.trajectory_slice(trajectory(spark, sf), "tool", True).select("ordinal", "text")


@query("t04_spine", f"WITH {TS} SELECT ordinal, actor, actor = 'tool' AND octet_length(encode(text)) > 200 AS omitted, CASE WHEN NOT (actor = 'tool' AND octet_length(encode(text)) > 200) THEN text END AS text FROM ts")
def t04(spark, sf):
    return T.spine(trajectory(spark, sf), 200).select("ordinal", "actor", "omitted", "text")


@query("t05_omissions", f"WITH {TS} SELECT 0 AS unknown_actor, count(*) FILTER (actor = 'tool' AND octet_length(encode(text)) > 200) AS tool_payloads, 0 AS truncated_text, 0 AS invalid_json FROM ts")
def t05(spark, sf):
    recs = transcript_records(spark, sf)
    return T.omissions(trajectory(spark, sf), recs, 200)


@query("t06_cursor", f"WITH {TS} SELECT ordinal, sha256('transcript|g1|' || sha256('actor=tool') || '|' || (ordinal + 1)) AS cursor FROM ts WHERE actor = 'tool'")
def t06(spark, sf):
    rows = T.trajectory_slice(trajectory(spark, sf), "tool")
    return rows.select("ordinal", T.cursor(F.col("source_id"), F.lit("g1"), "actor=tool", F.col("ordinal") + 1).alias("cursor"))


@query("j24_item_type", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'command_execution' WHEN 1 THEN 'mcp_tool_call' WHEN 2 THEN 'reasoning' END AS item_type FROM part")
def j24(spark, sf):
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'CommandExecution' WHEN 1 THEN 'mcp-tool-call' WHEN 2 THEN 'reasoning' ELSE p_name END")
    return table(spark, sf, "part").select("p_partkey", N.item_type(name).alias("item_type"))
