"""Detection reads only what its signals ask for, with the same hits as whole records prepared."""

import json

from pyspark.sql import functions as F

from loomrecord.operators.records import parse_texts
from loomrecord.profiles import registry as P

RECORDS = {
    "agent": {"type": "tool_call", "data": {"event": {"call_id": 5, "content": "x"}}},
    "named": {"event": "message", "content": "x"},
    "null": {"event": None, "type": None, "role": None, "task": None, "level": None},
    "other": {"event": "strange", "role": "user", "session_id": "s"},
    "log": {"@t": "2024-01-01", "log": {"level": 30, "logger": "l"}, "Exception": "broken", "TraceId": "t"},
    "step": {"task_id": "a", "step": 1, "patch": None, "outcome": "failed"},
    "box": {"trajectory": [], "issue": "i"},
    "rollout": {"type": "event_msg", "timestamp": "t", "payload": {"type": "strange"}},
    "flat": {"type": "event_msg", "timestamp": "t", "payload": "text"},
    "item": {"type": "item.completed", "item": {"type": "CommandExecution"}},
    "pi": {"type": "message", "id": "x", "timestamp": "t", "message": {"role": "odd", "content": [{"type": "toolCall"}]}},
    "list": [1], "text": "type",
}
WANT = {
    ("agent", "generic-agent-events"): 0.86, ("named", "generic-agent-events"): 0.48, ("rollout", "codex-rollout"): 0.98, ("item", "codex-exec-jsonl"): 0.96, ("pi", "pi-coding-agent"): 0.9,
    ("log", "structured-application-log"): 0.94, ("box", "software-engineering-agent"): 0.98, ("step", "software-engineering-agent"): 0.885,
}
UNREAD = {"kimi-code-session": "_text", "generic-agent-events": "_other_text_v", "software-engineering-agent": "_kind", "opentelemetry": "_body", "claude-code-session": "_call", "codex-rollout": "_it"}


def test_scores(spark):
    df = parse_texts(spark.createDataFrame([(k, i, json.dumps(r)) for i, (k, r) in enumerate(RECORDS.items())], "source_id string, ordinal long, text string"))
    got = {(r.source_id, r.profile_id): r.score for r in P.detection_scores(df).where("score > 0").collect()}
    for key, score in WANT.items():
        assert got[key] == score, (key, got.get(key))
    assert not {s for s, _ in got} & {"null", "other", "list", "text"} and ("flat", "codex-rollout") not in got
    for name, column in UNREAD.items():
        p = P.PROFILES[name]
        assert column in p.prepare(df).columns and column not in p.screen(df).columns
        assert isinstance(p.project(df).select(F.count(F.lit(1))).schema[0].name, str)
