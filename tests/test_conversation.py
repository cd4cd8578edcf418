"""The walk against a recursive one in Python."""

import json
import random
import re

from pyspark.sql import functions as F

from loomrecord.operators.conversation import DATASET_SLOTS, ENVELOPES, MESSAGE_SLOTS, ROLES, TEXT_SLOTS, THOUGHTS, conversation_walk, nesting


def brute(value, actor="unknown", kind="Record"):
    parts, hidden = [], False

    def visit(v, path, role, label):
        nonlocal hidden
        if isinstance(v, str):
            if v:
                parts.append((role or "unknown", label, v, path))
        elif isinstance(v, list):
            for i, x in enumerate(v):
                visit(x, f"{path}[{i}]", role, label)
        elif isinstance(v, dict):
            if v.get("hidden") is True or "encrypted" in v or isinstance(v.get("type"), str) and re.search("image|audio|video|file|base64", v["type"], re.I):
                hidden = True
                return
            role = next((v[k] for k in ("role", "from") if isinstance(v.get(k), str)), role)
            role = ROLES.get(role, role)
            for k in MESSAGE_SLOTS:
                if k in v:
                    return visit(v[k], f"{path}.{k}", role, label)
            for k in TEXT_SLOTS:
                if isinstance(v.get(k), str):
                    return visit(v[k], f"{path}.{k}", *(("reasoning", "Reasoning") if k in THOUGHTS else (role, label)))
            slots = [k for k in DATASET_SLOTS if isinstance(v.get(k), (str, list))]
            for k in slots:
                tool = k == "output" and (role == "tool" or label == "tool_result")
                visit(v[k], f"{path}.{k}", *(("tool", "Tool result") if tool else DATASET_SLOTS[k]))
            for k in [] if slots else ENVELOPES:
                if isinstance(v.get(k), dict):
                    return visit(v[k], f"{path}.{k}", role, label)
    visit(value, "$", actor, kind)
    return parts, hidden


def walked(spark, values, **options):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string").select("i", F.parse_json("t").alias("v")).select("i", conversation_walk(F.col("v"), **options).alias("c"))
    return [([tuple(p) for p in r.c.parts], r.c.truncated) for r in df.orderBy("i").collect()]


def test_walk(spark):
    rnd = random.Random(11)
    keys = [*MESSAGE_SLOTS, *TEXT_SLOTS, *DATASET_SLOTS, *ENVELOPES, "role", "from", "type", "hidden", "encrypted", "other"]

    def some(depth):
        roll = rnd.random()
        if depth == 0 or roll < .25:
            return rnd.choice(["a", "", "human", "x\ny", "\"]}", 5, None, True, "image_url", "tool"])
        if roll < .45:
            return [some(depth - 1) for _ in range(rnd.randrange(4))]
        picked = rnd.sample(keys, rnd.randrange(4))
        return {k: rnd.choice(["user", "gpt", "tool", "observation", "", 3]) if k in ("role", "from") else rnd.choice(["text", "image", "x"]) if k == "type" else rnd.random() < .3 if k == "hidden" else some(depth - 1) for k in picked}
    deep = {"role": "human", "text": "bottom"}
    for i in range(200):
        deep = [{"content": deep}, {"payload": deep}, [deep], {"parts": [deep, "s"]}][i % 4 if i % 40 else 3]
    values = [some(5) for _ in range(400)] + [deep, "text", 7, None, [], {}, {"output": "o", "role": "observation"}, {"content": None, "text": "unseen"}, {"chosen_messages": [{"from": "gpt", "value": "v"}], "prompt": "p"}]
    assert walked(spark, values) == [brute(v) for v in values]


def test_bounds_and_event(spark):
    record = {"messages": [{"role": "user", "content": "abcdef"}, {"role": "gpt", "content": [{"type": "text", "text": "ghi"}, {"type": "image", "text": "no"}]}, {"body": "jkl"}]}
    (parts, cut), = walked(spark, [record], max_parts=2, max_chars=8)
    assert [p[2] for p in parts] == ["abcdef", "gh"] and cut
    (parts, cut), = walked(spark, [{"output": "o"}], actor=F.lit("agent"), kind=F.lit("tool_result"))
    assert parts == [("tool", "Tool result", "o", "$.output")] and not cut
    (parts, _), = walked(spark, [["s"]], actor=F.lit("agent"), kind=F.lit("message"))
    assert parts == [("agent", "message", "s", "$[0]")]
    df = spark.createDataFrame([('[{"a":"]]]["}]',), ("7",), ("[]",), (None,)], "t string").select(nesting(F.parse_json("t")).alias("n"))
    assert [r.n for r in df.collect()] == [2, 0, 0 + 1, None]
