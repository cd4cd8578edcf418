"""Expected rows by hand."""

import json

from pyspark.sql import functions as F

from loomrecord.functions.content import code_language, content_class, decoded_text
from loomrecord.functions.features import Feature, semantic_features
from loomrecord.operators import page, parts
from loomrecord.operators.records import parse_texts
from loomrecord.profiles import registry as P
from loomrecord.profiles.engineering import ENGINEERING


def parsed(spark, groups):
    rows = [(s, i, json.dumps(r)) for s, rs in groups.items() for i, r in enumerate(rs)]
    return parse_texts(spark.createDataFrame(rows, "source_id string, ordinal long, text string"))


def over(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)])
    return [tuple(r)[1:] for r in df.orderBy("i").collect()]


def test_content_class(spark):
    cases = [
        ('{"role":"assistant","ok":true}', "json"), ("  [1, 2]\n", "json"), ('"{\\"a\\":1}"', "json"), ('{"a":1} {"b":2}', "json"), ("7", "text"), ('"word"', "text"), ("{broken", "text"), ('x {"a":1} y', "json"), ("x [1] y", "json"),
        ('# Title\n{"a":1}', "markdown"), ("\u001b[32m1: # Result\u001b[0m\n\u001b[32m2: - ready\u001b[0m", "markdown"), ("1: # Result\nplain\nplain\nplain\nplain", "text"), ("a\n> quoted", "markdown"), ("#no heading", "text"), ("#\nfoo", "text"),
        ("-\nfoo", "text"), ("3) third", "markdown"), ("3.14 is pi", "text"), ("* * *", "markdown"), ("--", "text"), ("a | b\n--- | ---\n1 | 2", "markdown"), ("a b\n--- | ---", "text"), ("say **loud** now", "markdown"), ("see [x](y)", "markdown"),
        ("````python\r\n", "markdown"), ("first\\n# second", "markdown"), ("C:\\temp\\x", "text"), ("", "text"), (None, None), ("*" * 200000, "markdown"), ("[" * 5000, "text"), ("w " * 200000, "text"), ('{"a":' * 30 + "1" + "}" * 30, "json"),
    ]
    assert [a for a, in over(spark, [t for t, _ in cases], content_class(F.col("t")))] == [k for _, k in cases]


def test_decoded_text(spark):
    cases = [('"a\\nb"', "a\nb"), ("a\\r\\nb\\nc\\\"", 'a\nb\nc"'), ('{"a":"x\\ny"}', '{"a":"x\\ny"}'), ("C:\\dir", "C:\\dir"), (None, None), ("", "")]
    assert [a for a, in over(spark, [t for t, _ in cases], decoded_text(F.col("t")))] == [k for _, k in cases]


def test_code_language(spark):
    cases = [("cargo test\nif [ -f package.json ]; then echo ready; fi", "shell"), ("const answer = await run();", "javascript"), ("ordinary text", None), ("42: pub fn go() {\n43: let x = 1;", "rust"), ("import os\nx = None", "python"),
             ("äfi then", None), (None, None), ("", None)]
    assert [a for a, in over(spark, [t for t, _ in cases], code_language(F.col("t")))] == [k for _, k in cases]
    assert over(spark, ["ordinary text"], code_language(F.col("t"), F.lit(" Custom ")), code_language(F.col("t"), F.lit(" "))) == [("custom", None)]


def test_features(spark):
    records = [{"content": {"type": "User", "content": "# Memory", "rawContent": "raw"}}, {"blocks": [{"text": "noise"}, {"TE-XT": ""}], "other": 1}, {"text": None, "Text": [], "t.e.x.t": [1]}, [{"text": {"text": 5}}], 7, {}]
    df = semantic_features(parsed(spark, {"s": records}), [Feature("content", ("content",), 1.1), Feature("text", ("text",)), Feature("words", ("text",), 0.3, ("string",))])
    got = [(r.ordinal, r["rank"], r.feature, r.path, round(r.score, 6)) for r in df.orderBy("ordinal", "rank").collect()]
    assert got == [
        (0, 1, "content", "$.content.content", 1.25), (0, 2, "content", "$.content", 1.14),
        (1, 1, "text", "$.blocks[0].text", 1.1), (1, 2, "text", '$.blocks[1]["TE-XT"]', 0.9), (1, 3, "words", "$.blocks[0].text", 0.4), (1, 4, "words", '$.blocks[1]["TE-XT"]', 0.2),
        (2, 1, "text", '$["t.e.x.t"]', 1.08), (2, 2, "text", "$.Text", 1.04), (2, 3, "text", "$.text", 1.0),
        (3, 1, "text", "$[0].text", 0.99), (3, 2, "text", "$[0].text.text", 0.9)]
    best = semantic_features(parsed(spark, {"s": records}), [Feature("content", ("content",), 1.1)], most=1).collect()
    assert [(r.path, r["rank"]) for r in best] == [("$.content.content", 1)]


def test_engineering(spark):
    cases = [
        ({"trajectory": [1, 2], "task": "fix"}, {"event_kind": "task", "summary": "Trajectory container: 2 steps", "actor": "system"}), ({"type": "Failure", "step": 1}, {"event_kind": "error", "severity": "error", "turn_id": "1"}),
        ({"outcome": {"status": "FAILED"}, "observation": "x"}, {"event_kind": "error", "status": "FAILED", "summary": "Failed: x"}), ({"outcome": "no errors"}, {"event_kind": "result"}), ({"test": "1 error"}, {"event_kind": "error"}),
        ({"observation": "seen", "step": 2, "parentStep": 1}, {"event_kind": "observation", "tool_call_id": "2", "message_id": None, "parent_id": "1", "summary": "Observation: seen"}),
        ({"action": {"name": "ls", "command": "ls -l"}, "step_id": "s", "call_id": "c"}, {"event_kind": "action", "summary": "Tool ls: ls", "tool_call_id": "c", "message_id": "s", "actor": "agent"}), ({"kind": "checkpoint"}, {"event_kind": "patch"}),
        ({"task_id": 7}, {"event_kind": "task", "session_id": "7", "summary": "Task: 7"}), ({"task_id": 7, "step": 0}, {"event_kind": "turn", "turn_id": "0", "message_id": "0"}), ({"foo": 1}, {"event_kind": "other", "actor": "system"}), ([1], {"event_kind": "other", "actor": None}), ({"task": None}, {"event_kind": "other"}),
    ]
    rows = ENGINEERING.project(parsed(spark, {"s": [r for r, _ in cases]}), evidence=True).orderBy("ordinal").collect()
    for (record, want), got in zip(cases, rows, strict=True):
        assert {k: got[k] for k in want} == want, record
        assert all(e.path.split(".")[-1] in json.dumps(record) for e in got.evidence), (record, got.evidence)
    groups = {"container": [{"trajectory": [], "task": "t"}], "steps": [{"step": 1, "action": "a", "problem_statement": "p"}, {"step": 2, "observation": "o", "task_id": 1}], "plain": [{"step": 1, "action": "a"}] * 3}
    assert {r.source_id for r in P.detection_scores(parsed(spark, groups)).where("profile_id = 'software-engineering-agent' and eligible").collect()} == {"container", "steps"}


def test_columns_and_parts(spark):
    ids = [c["id"] for c in page.default_columns("codex-exec-jsonl", [{"id": "status", "path": ["x"]}, {"id": "mine", "path": ["y"]}])]
    assert ids == ["event_kind", "summary", "actor", "status", "session_id", "model", "mine"]
    assert page.default_columns("codex-exec-jsonl", [{"id": "status", "path": ["x"]}])[3] == {"id": "status", "field": "status"}
    assert page.default_columns("generic") == [] and len(page.default_columns("opentelemetry", [{"id": "a", "path": ["a"]}], most=12)) == 12
    assert parts.default_parts("generic") == {"conversation": True, "dataset": True} and not parts.default_parts("codex-trace")["dataset"]
    assert parts.covers({"conversation": True}, {"conversation": True, "dataset": False}) and not parts.covers({"conversation": True}, {"dataset": True})
    rows = parsed(spark, {"s": [{"text": "x", "language": "en"}, {"traceId": "a" * 32, "spanId": "b" * 16, "name": "op", "startTimeUnixNano": "1", "endTimeUnixNano": "2"}, 5]})
    assert parts.with_parts(rows).columns == rows.columns
    got = parts.with_parts(rows, conversation=True, dataset=True, profile="opentelemetry").orderBy("ordinal").collect()
    assert [r.dataset.scene for r in got] == ["pretraining", "unknown", "unknown"] and [r.calls for r in got] == [None] * 3 and [r.telemetry and r.telemetry.spans for r in got] == [None, 1, None]
