"""Wire logs and journals against rows written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from loomrecord.operators import trajectory as T
from loomrecord.operators.records import parse_texts
from loomrecord.profiles import registry as P
from loomrecord.profiles.wires import JOURNAL_KINDS, SESSION_WIRE

CLOCK = "2026-10-16T04:00:00.001Z"
HEADER = {"kind": "journal_header", "version": 1, "epoch": "e", "created_at": 1792123200000}
METADATA = {"type": "metadata", "protocol_version": "1.5", "created_at": 1792123200000}


def event(kind, seq=1, **body):
    return {"kind": "event", "seq": seq, "envelope": {"type": kind, "seq": seq, "timestamp": CLOCK, "payload": {"type": kind, "agentId": "main", "sessionId": "s1", **body}}}


def loop(kind, **body):
    return {"type": "context.append_loop_event", "time": 1792123200002, "agentId": "main", "event": {"type": kind, **body}}


def parsed(spark, groups):
    rows = [(s, i, json.dumps(r) if not isinstance(r, str) else r) for s, rs in groups.items() for i, r in enumerate(rs)]
    return parse_texts(spark.createDataFrame(rows, "source_id string, ordinal long, text string"))


def projected(spark, records):
    rows = SESSION_WIRE.project(parsed(spark, {"s": records}), evidence=True).withColumn("derived", F.to_json("derived")).orderBy("ordinal").collect()
    return [dict(r.asDict(True), derived=json.loads(r.derived), evidence={e.field: e.path for e in r.evidence}) for r in rows]


WIRE = [
    (METADATA, {"event_kind": "session", "actor": "system", "summary": "Kimi wire protocol: 1.5", "timestamp_raw": "2026-10-16T04:00:00.000Z"}),
    ({"type": "context.append_message", "time": 1792123200001, "agentId": "main", "message": {"id": "m1", "role": "user", "content": [{"type": "text", "text": "List the files."}], "toolCalls": [], "origin": {"kind": "user"}}},
     {"event_kind": "message", "actor": "user", "message_id": "m1", "summary": "Kimi user: List the files.", "timestamp_raw": "2026-10-16T04:00:00.001Z"}),
    (loop("step.begin", uuid="u", turnId="0", step=1), {"event_kind": "turn", "actor": "assistant", "status": "running", "turn_id": "0", "message_id": None}),
    (loop("content.part", uuid="r1", stepUuid="u", part={"type": "think", "think": "Look first."}), {"event_kind": "reasoning", "message_id": "r1", "summary": "Kimi reasoning: Look first."}),
    (loop("content.part", uuid="r1", stepUuid="u", part={"type": "think", "think": "secret", "encrypted": ""}), {"summary": "Kimi reasoning: [hidden reasoning]"}),
    (loop("tool.call", uuid="c1", stepUuid="u", toolCallId="call-1", name="Bash", args={"command": "printf x"}), {"event_kind": "tool_call", "tool_call_id": "call-1", "message_id": "c1", "summary": "Kimi tool: Bash"}),
    (loop("tool.result", toolCallId="call-1", parentUuid="c1", result={"output": "x", "isError": False}),
     {"event_kind": "tool_result", "actor": "tool", "tool_call_id": "call-1", "parent_id": "c1", "status": "completed", "severity": None, "summary": "Kimi tool result: x"}),
    (loop("tool.result", toolCallId="call-1", result={"output": ""}), {"event_kind": "tool_result", "status": None, "summary": "Kimi tool result: [empty output]"}),
    (loop("step.end", uuid="u", turnId=3, finishReason="completed", usage={"inputOther": 11, "inputCacheRead": 7, "inputCacheCreation": 3, "output": 5}),
     {"event_kind": "turn", "status": "completed", "turn_id": "3", "usage": {"input": 21.0, "output": 5.0, "cached": 7.0, "total": 26.0}}),
    ({"type": "context.append_message", "message": {"role": "assistant", "content": [], "toolCalls": [{"id": "k1", "function": {"name": "ls"}}]}}, {"event_kind": "tool_call", "tool_call_id": "k1", "summary": "Kimi assistant: ls"}),
    ({"type": "context.append_message", "message": {"role": "assistant", "content": [], "toolCalls": [{"id": "k1", "name": "ls"}, {"id": "k2"}]}}, {"event_kind": "tool_call", "tool_call_id": None}),
    ({"type": "context.append_message", "message": {"role": "tool", "toolCallId": "k1", "content": "gone", "isError": True}}, {"event_kind": "tool_result", "tool_call_id": "k1", "status": "error", "severity": "error"}),
    ({"type": "agent.message.appended", "kind": "event", "message": {"message": {"role": "assistant", "content": [{"type": "image_url"}]}}}, {"event_kind": "message", "summary": "Kimi assistant: [image reference]"}),
    ({"type": "agent.message.appended", "message": {"message": {"role": "assistant", "content": []}}}, {"event_kind": "other", "summary": "Kimi: agent.message.appended"}),
    ({"type": "agent.turn.ended", "kind": "event", "turnId": 2, "outcome": "done"}, {"event_kind": "turn", "turn_id": "2", "status": "completed", "summary": "Kimi agent turn ended: done", "actor": "assistant"}),
    ({"type": "turn.ended", "agentId": "a", "turnId": 1, "reason": "odd"}, {"event_kind": "other", "status": None}),
    ({"type": "turn.prompt", "input": [{"type": "text", "text": "Go"}], "origin": {"kind": "user"}}, {"event_kind": "message", "actor": "user", "summary": "Kimi prompt: Go"}),
    ({"type": "llm.request", "agentId": "a", "provider": "p", "model": "m", "systemPromptHash": "h", "toolsHash": "t", "kind": "loop", "toolSelect": False, "messageCount": 3}, {"event_kind": "observation", "summary": "Kimi LLM request: p/m", "model": None}),
    ({"type": "llm.request", "agentId": "a", "provider": "p", "model": "m", "systemPromptHash": "h", "toolsHash": "t", "kind": "loop", "toolSelect": 0, "messageCount": 3}, {"event_kind": "other"}),
    ({"type": "usage.record", "agentId": "a", "model": "m", "usage": {"inputOther": 1, "output": 2, "inputCacheRead": 3, "inputCacheCreation": 4}}, {"event_kind": "observation", "usage": {"input": 8.0, "output": 2.0, "cached": 3.0, "total": 10.0}}),
    ({"type": "task.terminated", "agentId": "a", "info": {"taskId": "t", "description": "d", "status": "killed", "kind": "k", "startedAt": 1, "endedAt": None}}, {"event_kind": "task", "status": "killed", "summary": "Kimi task ended: d"}),
    ({"type": "context.apply_compaction", "summary": "short"}, {"event_kind": "checkpoint", "summary": "Kimi compaction: short"}),
    ({"type": "full_compaction.cancel"}, {"event_kind": "checkpoint", "status": "cancelled", "summary": "Kimi: full_compaction.cancel"}),
    ({"type": "turn.step.retrying", "errorMessage": "slow", "turnId": 4}, {"event_kind": "error", "status": "retrying", "severity": "warning", "turn_id": "4", "summary": "Kimi turn.step.retrying: slow"}),
    ({"type": "tools.set_active_tools", "names": ["a", "b"]}, {"event_kind": "observation", "summary": "Kimi active tools: a, b"}),
    ({"type": "mcp.tools_discovered", "serverName": "srv", "hash": "h", "enabledNames": ["a"], "tools": [{"name": "a", "description": "d", "inputSchema": {}}]}, {"event_kind": "observation", "summary": "Kimi MCP discovery: 1 tools from srv"}),
    ({"type": "mcp.tools_discovered", "serverName": "srv", "hash": "h", "enabledNames": [1], "tools": []}, {"event_kind": "other"}),
    ({"type": "plugin.session_start", "agentId": "a", "content": None}, {"event_kind": "session"}),
    ({"type": "plugin.session_start", "agentId": "a"}, {"event_kind": "other"}),
    ({"type": "who.knows", "text": "not read"}, {"event_kind": "other", "actor": None, "summary": "Kimi: who.knows", "confidence": "inferred"}),
    ([1], {"event_kind": "other"}), ("{broken", {"event_kind": "other"}), ("", {"event_kind": "other"}),
    ({"type": "context.append_message", "message": {"role": "user", "id": "x" * 2049, "content": "y" * 5000, "toolCalls": []}}, {"event_kind": "message", "message_id": None}),
]

JOURNAL = [
    (HEADER, {"event_kind": "session", "summary": "Kimi server journal v1", "actor": "system"}),
    (event("prompt.submitted", userMessageId="u1", status="running", content=[{"type": "text", "text": "Inspect a file."}]),
     {"event_kind": "message", "actor": "user", "message_id": "u1", "session_id": "s1", "status": "running", "timestamp_raw": CLOCK, "summary": "Kimi: Inspect a file."}),
    (event("event.session.created", session={"title": "Title", "status": "idle"}), {"event_kind": "session", "status": "idle", "summary": "Kimi: Title"}),
    (event("session.meta.updated", patch={"title": "New"}), {"event_kind": "session", "summary": "Kimi: New"}),
    (event("prompt.completed", reason="blocked"), {"event_kind": "turn", "status": "blocked", "actor": "system"}),
    (event("prompt.aborted"), {"event_kind": "turn", "status": "aborted"}),
    (event("turn.started", turnId=0, origin={"kind": "user"}), {"event_kind": "turn", "turn_id": "0", "status": "running"}),
    (event("turn.step.completed", turnId=0, finishReason="completed", usage={"inputOther": 11, "inputCacheRead": 7, "inputCacheCreation": 3, "output": 5}), {"event_kind": "turn", "status": "completed", "usage": {"input": 21.0, "output": 5.0, "cached": 7.0, "total": 26.0}}),
    (event("turn.step.retrying", errorMessage="again"), {"event_kind": "error", "status": "retrying", "severity": "warning", "summary": "Kimi: again"}),
    (event("turn.ended", turnId=0, reason="failed", error={"message": "broke"}), {"event_kind": "turn", "status": "failed", "severity": "error", "summary": "Kimi: broke"}),
    (event("context.spliced", messages=[{"id": "a1", "role": "assistant", "content": [{"type": "text", "text": "Reply"}]}]), {"event_kind": "message", "actor": "assistant", "message_id": "a1", "summary": "Kimi: Reply"}),
    (event("context.spliced", messages=[]), {"event_kind": "checkpoint", "actor": "system"}),
    (event("error", code="internal", message="bad", retryable=True), {"event_kind": "error", "severity": "error", "summary": "Kimi: bad"}),
    (event("mcp.server.status", server={"name": "tools", "status": "connected"}), {"event_kind": "observation", "status": "connected", "summary": "Kimi: tools"}),
    (event("event.config.warning", warnings=[{"message": "odd"}, {"message": "odder"}]), {"event_kind": "observation", "severity": "warning", "summary": "Kimi: odd odder"}),
    (event("prompt.queued", content=[{"type": "text", "text": "Later"}]), {"event_kind": "message", "actor": "user", "status": "queued"}),
    (event("turn.steer", messageId="sm", input=[{"type": "text", "text": "Left"}]), {"event_kind": "message", "actor": "user", "message_id": "sm", "summary": "Kimi: Left"}),
    (event("task.notified", title="Note", severity="info"), {"event_kind": "task", "severity": "info", "summary": "Kimi: Note"}),
    (event("event.question.requested", turn_id=1, tool_call_id="q", questions=[{"question": "Choose."}]), {"event_kind": "approval", "actor": "assistant", "status": "requested", "tool_call_id": "q", "turn_id": "1", "summary": "Kimi: Choose."}),
    (event("event.approval.resolved", decision="deny", feedback="No"), {"event_kind": "approval", "actor": "user", "status": "deny", "summary": "Kimi: No"}),
    (event("subagent.failed", subagentId="x", error="late"), {"event_kind": "subagent", "actor": "agent", "subagent_id": "x", "status": "failed", "severity": "error", "summary": "Kimi: late"}),
    (event("compaction.completed", result={"summary": "less"}), {"event_kind": "checkpoint", "status": "completed", "summary": "Kimi: less"}),
    (event("tool.result", toolCallId="k", output="text", isError=True), {"event_kind": "tool_result", "actor": "tool", "tool_call_id": "k", "status": "error", "severity": "error", "summary": "Kimi: text"}),
    (event("shell.completed", isError=False), {"event_kind": "task", "actor": "tool", "status": "completed"}),
    (event("task.started", info={"description": "work", "status": "running"}), {"event_kind": "task", "status": "running", "summary": "Kimi: work"}),
    (event("thinking.delta", delta="hm"), {"event_kind": "reasoning", "actor": "assistant", "summary": "Kimi: hm"}),
    (event("future.event", text="not read"), {"event_kind": "other", "session_id": "s1", "summary": "Kimi: future.event"}),
    (event("turn.started", turnId=-1), {"turn_id": None}),
    ({**event("error"), "seq": 2}, {"event_kind": "other", "session_id": None}),
]


@pytest.mark.parametrize("cases", [WIRE, JOURNAL], ids=["wire", "journal"])
def test_projection(spark, cases):
    for (record, want), got in zip(cases, projected(spark, [r for r, _ in cases]), strict=True):
        assert {k: got[k] for k in want} == want, record
        for field, path in got["evidence"].items():
            node = record
            for key in path.replace("[0]", ".0").split(".")[1:]:
                node = node[int(key)] if isinstance(node, list) else node[key]
            assert node is not None, (field, path)


def test_every_journal_type_has_a_kind(spark):
    assert "other" not in {r["event_kind"] for r in projected(spark, [event(t) for t in JOURNAL_KINDS])}


def test_evidence_paths(spark):
    one, two = projected(spark, [event("prompt.submitted", userMessageId="u", content=[]), {**WIRE[6][0]}])
    assert one["evidence"] == {"event_kind": "$.envelope.type", "timestamp_raw": "$.envelope.timestamp", "session_id": "$.envelope.payload.sessionId", "message_id": "$.envelope.payload.userMessageId"}
    assert two["evidence"]["status"] == "$.event.result.isError" and two["evidence"]["tool_call_id"] == "$.event.toolCallId"


def test_detection(spark):
    submitted, started, done = event("prompt.submitted", 1, content=[]), event("turn.started", 2, turnId=0), event("turn.step.completed", 3, turnId=0)
    bare = {**submitted, "envelope": {**submitted["envelope"], "payload": {"type": "prompt.submitted"}}}
    groups = {"wire": [r for r, _ in WIRE[:9]], "journal": [HEADER, submitted], "headless": [submitted, started, done], "header": [HEADER], "one": [submitted],
              "errors": [event("error")] * 3, "future": [event("future.event")] * 3, "bare": [HEADER, bare], "mixed": [METADATA, submitted]}
    rows = P.detection_scores(parsed(spark, groups)).where("profile_id = 'kimi-code-session' and eligible").collect()
    assert {r.source_id for r in rows} == {"wire", "journal", "headless"}
    chosen = {r.source_id: r.profile_id for r in P.detect(parsed(spark, groups)).collect()}
    assert {k for k, v in chosen.items() if v == "kimi-code-session"} == {"wire", "journal", "headless"}


def test_error_evidence(spark):
    records = [loop("tool.result", result={"output": "", "isError": True}), loop("tool.result", result={"output": ""}), loop("tool.call", isError=True), event("tool.result", isError=False),
               event("turn.ended", isError=True), {"type": "context.append_message", "message": {"role": "tool", "isError": False}}, {"type": "who.knows", "isError": True}]
    df = parsed(spark, {"s": records}).select("ordinal", T.has_error(F.lit("kimi-code-session@5"), F.col("value")).alias("e"))
    assert [r.e for r in df.orderBy("ordinal").collect()] == [True, None, None, False, None, False, None]
