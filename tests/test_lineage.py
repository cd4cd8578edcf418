"""Lineage rules on small cases whose right rows are written out by hand."""

import json

import pytest

from loomrecord.operators import lineage as L
from loomrecord.operators.records import parse_texts
from loomrecord.profiles import transcripts as N
from loomrecord.profiles.telemetry import TELEMETRY

SCHEMA = """source_id string, generation string, profile_id string, ordinal long, event_kind string, session_id string, turn_id string, message_id string, parent_id string, tool_call_id string,
  summary string, confidence string, evidence array<struct<field:string,path:string>>"""
UUID, PARENT, CALL = ("message_id", "$.uuid"), ("parent_id", "$.parentUuid"), ("tool_call_id", "$.payload.call_id")


def event(n, profile="claude-code-session", kind="message", session="s", turn="t", message=None, parent=None, call=None, proof=(UUID, PARENT, CALL), generation="g", confidence="source", source="doc"):
    return (source, generation, profile, n, kind, session, turn, message, parent, call, f"row {n}", confidence, [p for p in proof])


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def edges(df):
    return sorted((r.kind, r.src, r.dst) for r in L.lineage_edges(df).collect())


def issues(df):
    return sorted((r.ordinal, r.reason) for r in L.lineage_issues(df).collect())


def test_parents_and_directions(spark):
    df = frame(spark, event(1, message="p"), event(2, message="a", parent="p"), event(3, message="b", parent="p"), event(4, parent="b"), event(5, parent="a"), event(6, message="other"))
    assert edges(df) == [("parent", 1, 2), ("parent", 1, 3), ("parent", 2, 5), ("parent", 3, 4)] and issues(df) == []
    nodes, reasons = L.neighbourhood(L.lineage_edges(df), 2)
    assert sorted(map(tuple, nodes.collect())) == [(1, 1, "ancestor"), (2, 0, "selected"), (3, 2, "related"), (4, 3, "related"), (5, 1, "descendant")] and reasons == []


def test_duplicates_are_ambiguous(spark):
    df = frame(spark, event(1, message="dup"), event(2, message="dup"), event(3, parent="dup"))
    assert edges(df) == [] and issues(df) == [(1, "ambiguous-parent"), (2, "ambiguous-parent"), (3, "ambiguous-parent")]
    assert {(r.reason, r.records, r.ambiguous) for r in L.lineage_coverage(df).collect()} == {("ambiguous-parent", 3, True)}


def test_ids_stay_in_their_profile_session_turn_generation_and_source(spark):
    df = frame(spark, event(1, message="x", session="other"), event(2, message="x", turn="other"), event(3, profile="pi-coding-agent", message="x", proof=[("message_id", "$.id")]),
               event(4, message="x", generation="old"), event(5, message="x", source="elsewhere"), event(6, parent="x"))
    assert edges(df) == [] and issues(df) == [(6, "unmatched-parent")]


@pytest.mark.parametrize("parent, child", [((None, None), (None, None)), (("s", "t"), (None, "t")), (("s", "t"), ("s", None)), ((None, "t"), ("s", "t")), (("s", None), ("s", "t")), ((" \t", "t"), ("s", "t"))])
def test_missing_context(spark, parent, child):
    df = frame(spark, event(1, message="m", session=parent[0], turn=parent[1]), event(2, parent="m", session=child[0], turn=child[1]))
    assert edges(df) == [] and issues(df) == [(2, "missing-parent-context")]


def test_only_exact_paths_with_source_confidence_prove(spark):
    df = frame(spark, event(1, message="m"), event(2, parent="m", proof=[("parent_id", "$.nested.parent")]), event(3, parent="m", confidence="inferred"), event(4, profile="generic-agent-events", parent="m"),
               event(5, message="n", proof=[("message_id", "$.leafUuid")]), event(6, parent="n"))
    assert edges(df) == []
    assert issues(df) == [(2, "unverified-parent-evidence"), (3, "unverified-parent-evidence"), (4, "unverified-parent-evidence"), (6, "unmatched-parent")]
    pi = frame(spark, event(1, "pi-coding-agent", message="m", proof=[("message_id", "$.id")]), event(2, "pi-coding-agent", parent="m", proof=[("parent_id", "$.parentId")]))
    assert edges(pi) == [("parent", 1, 2)]


def test_tool_pairs(spark):
    tool = lambda n, kind, call="k", **more: event(n, "codex-rollout", kind, call=call, **more)
    df = frame(spark, tool(1, "tool_call"), tool(2, "tool_result"), tool(3, "tool_call", turn="t2"), tool(4, "tool_call", "d"), tool(5, "tool_call", "d"), tool(6, "tool_result", "d"),
               tool(7, "tool_call", "n", turn=None), tool(8, "tool_result", "n", session=None), tool(9, "tool_result", "u", proof=[("tool_call_id", "$.call_id")]), event(10, kind="tool_call", call="k"))
    assert edges(df) == [("responds", 1, 2)]
    assert issues(df) == [(3, "unmatched-tool-pair"), (4, "ambiguous-tool-pair"), (5, "ambiguous-tool-pair"), (6, "ambiguous-tool-pair"), (7, "missing-tool-context"), (8, "missing-tool-context"), (9, "unverified-tool-evidence")]


def test_repeated_places_take_no_part(spark):
    df = frame(spark, event(1, message="p"), event(2, parent="p"), event(2, parent="p", session="different"))
    assert edges(df) == [] and issues(df) == [(2, "ambiguous-record-ref")]


def test_limits_are_reported(spark):
    chain = frame(spark, *[event(i, message=f"m{i}", parent=f"m{i - 1}" if i > 1 else None) for i in range(1, 7)])
    nodes, reasons = L.neighbourhood(L.lineage_edges(chain), 1)
    assert sorted(r.node for r in nodes.collect()) == [1, 2, 3, 4] and reasons == ["depth-limit"]
    star = frame(spark, event(1, message="root"), *[event(i, parent="root") for i in range(2, 22)])
    nodes, reasons = L.neighbourhood(L.lineage_edges(star), 1)
    assert [r.node for r in nodes.orderBy("node").collect()] == list(range(1, 16)) and reasons == ["node-limit"]


def parsed(spark, *values):
    return parse_texts(spark.createDataFrame([("doc", i, json.dumps(v)) for i, v in enumerate(values, 1)], "source_id string, ordinal long, text string"))


def test_spans_and_logs(spark):
    span = lambda t, s, p=None: {"traceId": t, "spanId": s, "parentSpanId": p, "name": "n", "startTimeUnixNano": "1", "endTimeUnixNano": "2"}
    log = lambda t, s: {"timeUnixNano": "1", "severityNumber": 9, "body": {"stringValue": "b"}, "traceId": t, "spanId": s}
    df = TELEMETRY.project(parsed(spark, span("t", "a"), span("t", "b", "a"), log("t", "b"), log("t", "0000"), log("000", "b"), span("t", "c", "00"), span("u", "d", "a"), log("t", "none")), evidence=True)
    assert edges(df) == [("parent", 1, 2), ("span-context", 2, 3)]
    assert issues(df) == [(5, "missing-parent-context"), (7, "unmatched-parent"), (8, "unmatched-parent")]


def test_rollout_events_and_their_paths(spark):
    """Names of event messages count as they are written; items by their life cycle; ids with the paths they were read from."""
    msg = lambda kind, **p: {"timestamp": "t", "type": "event_msg", "payload": {"type": kind, **p}}
    item = lambda life, **i: msg(life, item=i)
    df = N.ROLLOUT.project(parsed(
        spark, msg("exec_command_begin", call_id="k", thread_id="s", turn_id="t"), msg("exec_command_end", call_id="k", session_id="s", turn_id="t"), msg("something_begin"), msg("environmentXconnected"),
        msg("approval_request"), item("item_started", type="commandExecution", id="i", stdout=""), item("item_completed", type="command-execution", id="i", exit_code=0), item("item_completed", type="extension", kind="clock.sleep", status="completed"),
        item("item_completed", type="unheard"), msg("collab_waiting_end", agent_id="x"), {"type": "function_call", "call_id": "z", "id": "m", "turn_id": "t", "timestamp": "t"},
        {"type": "token_usage_record", "payload": {"session_id": "s", "turn_id": "t", "root_turn_id": "r", "response_id": "q"}}), evidence=True)
    got = {r.ordinal: r for r in df.collect()}
    assert [got[i].event_kind for i in range(1, 13)] == ["tool_call", "tool_result", "other", "other", "approval", "tool_call", "tool_result", "action", "other", "subagent", "tool_call", "usage"]
    assert (got[1].session_id, got[2].session_id, got[10].subagent_id, got[12].parent_id) == ("s", "s", "x", "r")
    path = lambda i, f: {e.field: e.path for e in got[i].evidence}.get(f)
    assert (path(1, "session_id"), path(2, "session_id"), path(1, "tool_call_id")) == ("$.payload.thread_id", "$.payload.session_id", "$.payload.call_id")
    assert (path(6, "message_id"), path(6, "tool_call_id"), path(11, "tool_call_id"), path(11, "event_kind"), path(12, "message_id")) == ("$.payload.item.id", "$.payload.item.id", "$.call_id", "$.type", "$.payload.response_id")
    assert edges(df) == [("responds", 1, 2)]


def test_transcript_paths(spark):
    df = N.TRANSCRIPT.project(parsed(
        spark, {"type": "user", "sessionId": "s", "uuid": "a", "message": {"role": "user", "content": "hi"}},
        {"type": "assistant", "sessionId": "s", "uuid": "b", "parentUuid": "a", "message": {"role": "assistant", "content": [{"type": "text", "text": "x"}, {"type": "tool_use", "id": "k", "name": "n"}]}},
        {"type": "summary", "sessionId": "s", "leafUuid": "b"}), evidence=True)
    got = {r.ordinal: {e.field: e.path for e in r.evidence} for r in df.collect()}
    assert got[2] | {"event_kind": 0} == {"event_kind": 0, "session_id": "$.sessionId", "message_id": "$.uuid", "parent_id": "$.parentUuid", "tool_call_id": "$.message.content[1].id"}
    assert got[3]["message_id"] == "$.leafUuid" and edges(df) == [("parent", 1, 2)]


def test_document_graph(spark):
    tool = lambda n, kind, **more: event(n, "codex-rollout", kind, call="k", **more)
    df = frame(spark, event(1, message="a", session=None, turn=None), event(2, message="b", parent="a", session=None, turn=None), tool(3, "tool_call"), tool(4, "tool_result"), tool(5, "tool_call", session="z"),
               tool(6, "tool_result", session="z"), tool(7, "tool_result", session="z", proof=[]), event(8, kind="session"))
    nodes, found = L.document_graph(df)
    assert sorted((r.kind, r.src, r.dst) for r in found.collect()) == [("parent", 1, 2), ("responds", 4, 3)]
    assert sorted(r.kind for r in nodes.collect()) == ["event", "event", "session", "tool", "tool", "tool", "tool", "tool"]
