"""Benchmark rows against counts made by walking the values."""

import json
import random

from pyspark.sql import functions as F

from loomrecord.operators import dataset as D
from loomrecord.operators.records import parse_texts


def row(**over):
    base = {"id": "multiple_1", "multi_turn": True, "functions": json.dumps([{"name": "find", "parameters": {"type": "object", "required": ["id"]}}]),
            "tools": json.dumps([{"type": "function", "function": {"name": "find", "parameters": {"required": ["id"]}}}]), "missed_functions": json.dumps({"2": [[{"name": "gone", "parameters": {}}]]}),
            "initial_config": json.dumps({"Service": {"token": "t"}}), "involved_classes": ["Service"],
            "turns": json.dumps([[{"role": "system"}, {"role": "User"}], [{"role": "assistant"}]]), "language": "Python", "test_category": "multiple", "subset": "multiple", "ground_truth": json.dumps([["find(id='s')"]])}
    return {k: v for k, v in {**base, **over}.items() if v is not ...}


def summaries(spark, rows, **options):
    df = parse_texts(spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(rows)], "source_id string, ordinal long, text string"))
    return [r.asDict() for r in D.call_summary(df, **options).orderBy("ordinal").collect()]


def test_states_counts_and_issues(spark):
    cases = [
        (row(), {"valid": True, "issues": [], "functions_definitions": 1, "functions_parameters": 1, "functions_required": 1, "tools_valid": 1, "turns": 2, "turn_messages": 3, "system_messages": 1, "user_messages": 1,
                 "missed_functions_groups": 1, "missed_functions_calls": 1, "missed_functions_objects": 3, "ground_truth_groups": 1, "ground_truth_calls": 1, "config_keys": 1, "config_objects": 2, "classes": 1, "multi_turn": "true"}),
        (row(functions="{bad", tools=4, turns=json.dumps([{"role": "wrong"}]), involved_classes=["A", 4]),
         {"valid": False, "functions_state": "malformed", "tools_state": "type-mismatch", "turns_state": "valid", "invalid_turns": 1, "class_values": 1, "issues": ["malformed-json", "type-mismatch", "invalid-turn", "multi-turn-mismatch"]}),
        (row(ground_truth="{}"), {"valid": True, "ground_truth_state": "empty", "ground_truth_calls": 0}),
        (row(functions=...), {"valid": False, "functions_state": "missing", "issues": ["missing-field"]}),
        (row(functions=json.dumps(["x" * 70000])), {"functions_state": "over-budget", "issues": ["over-budget"], "functions_definitions": 0}),
        (row(involved_classes='["A", "A"]'), {"valid": True, "class_values": 2, "classes": 1}), (row(involved_classes="{}"), {"involved_classes_state": "type-mismatch"}),
        (row(language=""), {"issues": ["over-budget"], "language": None}), (row(language=7), {"issues": ["type-mismatch"]}), (row(multi_turn="yes"), {"multi_turn": "invalid", "issues": ["type-mismatch"]}),
        (row(turns=json.dumps([[{"role": "x"}, 5, {}]]), multi_turn=False), {"other_messages": 1, "invalid_turns": 2, "issues": ["invalid-turn"]}),
        (row(functions=json.dumps([{"name": 3}, 4])), {"functions_definitions": 2, "functions_valid": 0, "issues": ["invalid-definition"]}),
        (row(ground_truth='["a"] trailing'), {"ground_truth_state": "malformed"}), (row(ground_truth='"text"'), {"ground_truth_state": "type-mismatch", "ground_truth_calls": 0}), (row(turns=None), {"turns_state": "type-mismatch"}),
    ]
    for (r, want), got in zip(cases, summaries(spark, [r for r, _ in cases], characters=65536), strict=True):
        assert {k: got[k] for k in want} == want, r


def walk(v):
    if isinstance(v, str):
        return int(v != ""), 0
    inner = v.values() if isinstance(v, dict) else v if isinstance(v, list) else []
    sums = [walk(x) for x in inner]
    return sum(a for a, _ in sums), sum(b for _, b in sums) + isinstance(v, dict)


def test_counts_at_any_depth(spark):
    rnd = random.Random(5)
    texts = ["", "a", '"', '\\', '\\"', "{", "}:", ":", '":', '{"a":"b"}', "S", "S:", "é\n", "\\u0041", "☃😀"]

    def some(depth):
        if depth == 0 or rnd.random() < .3:
            return rnd.choice([*texts, 1, 2.5e30, True, None])
        return [some(depth - 1) for _ in range(rnd.randrange(4))] if rnd.random() < .5 else {rnd.choice(texts): some(depth - 1) for _ in range(rnd.randrange(4))}
    deep = "leaf"
    for i in range(200):
        deep = {"k": deep, "": ""} if i % 2 else [deep]
    values = [some(6) for _ in range(300)] + [deep]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string").select("i", D.leaf_counts(F.parse_json("t")).alias("n"))
    assert [(r.n.texts, r.n.objects) for r in df.orderBy("i").collect()] == [walk(v) for v in values]
