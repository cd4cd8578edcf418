"""Conversation parts and trajectory queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.profiles.wires import error_sql

# Words in type names of blocks that are media, whatever text they carry.
MEDIA = "image|audio|video|file|base64"
# Dataset slots and the role each one speaks for.
SLOTS = {"system": "system", "instruction": "user", "prompt": "user", "question": "user", "input": "user", "output": "assistant", "response": "assistant",
         "completion": "assistant", "answer": "assistant", "chosen": "assistant", "rejected": "assistant", "text": "unknown"}


def _opaque(x: str) -> str:
    """Hidden, encrypted (even if empty) and media items show no text."""
    hidden = J.get_sql(x, "hidden")
    return (f"(schema_of_variant({x}) LIKE 'OBJECT%' AND (coalesce(schema_of_variant({hidden}) = 'BOOLEAN' AND try_variant_get({x}, '$.hidden', 'boolean'), false) "
            f"OR {J.get_sql(x, 'encrypted')} IS NOT NULL OR coalesce(lower({J.string_sql(x, 'type')}) rlike '{MEDIA}', false)))")


def conversation_parts(value: Column, max_parts: int | None = None, max_chars: int | None = None) -> Column:
    """STRUCT<parts ARRAY<STRUCT<role,label,text,path>>, truncated> of a record's visible texts, in order.

    Message lists, a nested or enveloped message with text or blocks, then dataset
    slots. Reasoning blocks are labelled; hidden, encrypted and media items carry no
    text and count as truncation. `max_chars` is one budget that the parts share in
    order, `max_parts` their number; by default all of a record is shown.
    """
    table = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in J.ROLE_NAMES.items()) + ")"
    def parts(message: str, path: str, x: str) -> str:
        role = f"coalesce({table}[lower({J.coalesce_sql(J.string_sql(message, 'role'), J.string_sql(message, 'from'), J.string_sql(message, 'speaker'))})], 'unknown')"
        content = f"coalesce({J.nonnull_sql(message, 'content')}, {J.nonnull_sql(message, 'value')}, {J.get_sql(message, 'text')})"
        kind = J.string_sql(x, "type")
        label = f"if({kind} IN ('thinking', 'think', 'reasoning'), 'reasoning', 'text')"
        text = J.coalesce_sql(*[J.string_sql(x, k) for k in ("text", "thinking", "think", "content")])
        blocks = (f"transform(try_variant_get({content}, '$', 'array<variant>'), ({x}, i{x}) -> named_struct('role', {role}, 'label', if({_opaque(x)}, 'opaque', {label}), "
                  f"'text', CASE WHEN {_opaque(x)} THEN null WHEN schema_of_variant({x}) = 'STRING' THEN try_variant_get({x}, '$', 'string') ELSE {text} END, 'path', concat({path}, '[', i{x}, ']')))")
        one = f"array(named_struct('role', {role}, 'label', 'text', 'text', {J.string_sql(content)}, 'path', {path}))"
        none = f"array(named_struct('role', {role}, 'label', 'opaque', 'text', cast(null AS string), 'path', {path}))"
        return f"CASE WHEN {_opaque(message)} THEN {none} WHEN schema_of_variant({content}) = 'STRING' THEN {one} ELSE coalesce({blocks}, array()) END"
    lists = ", ".join(f"flatten(transform(coalesce(try_variant_get(v, '$.{f}', 'array<variant>'), array()), (m, k) -> {parts('m', f'''concat('$.{f}[', k, ']')''', 'b')}))" for f in ("messages", "conversations", "chosen_messages", "rejected_messages"))
    nested = ", ".join(f"if(schema_of_variant({J.get_sql('v', k)}) LIKE 'OBJECT%', {parts(J.get_sql('v', k), f'''concat('$.{k}')''', 'c')}, array())" for k in ("message", "payload"))
    own = parts("v", "concat('$.content')", "d")
    slots = ", ".join(f"array(named_struct('role', '{r}', 'label', '{k}', 'text', {J.string_sql('v', k)}, 'path', concat('$.{k}')))" for k, r in SLOTS.items() if k != "text")
    every = f"filter(concat({lists}, {nested}, {own}, {slots}), p -> p.label = 'opaque' OR p.text IS NOT NULL)"
    shown = "filter(a, p -> p.label != 'opaque')"
    if max_parts is not None:
        shown = f"slice({shown}, 1, {max_parts})"
    if max_chars is not None:
        fits = "named_struct('role', p.role, 'label', p.label, 'text', substring(p.text, 1, s.rest), 'path', p.path)"
        shown = (f"filter(aggregate({shown}, named_struct('rest', {max_chars}, 'out', filter(a, p -> false)), (s, p) -> named_struct('rest', greatest(0, s.rest - length(p.text)), "
                 f"'out', concat(s.out, array({fits}))), s -> s.out), p -> length(p.text) > 0)")
    total = "aggregate(a, 0, (n, p) -> n + coalesce(length(p.text), 0))"
    over = ["exists(a, p -> p.label = 'opaque')", *([f"size(filter(a, p -> p.label != 'opaque')) > {max_parts}"] if max_parts is not None else []), *([f"{total} > {max_chars}"] if max_chars is not None else [])]
    return J.let_sql(value, J.bind_sql(every, "a", f"named_struct('parts', {shown}, 'truncated', {' OR '.join(over)})"))


def has_error(profile: Column, value: Column) -> Column:
    """Explicit error evidence of a record; NULL when there is none."""
    flag = "try_variant_get(r, '$.is_error', 'variant')"
    results = f"filter(try_variant_get(v, '$.message.content', 'array<variant>'), b -> {J.string_sql('b', 'type')} = 'tool_result')"
    flags = f"transform({results}, r -> if(schema_of_variant({flag}) = 'BOOLEAN', try_variant_get(r, '$.is_error', 'boolean'), null))"
    block = J.bind_sql(flags, "fl", "CASE WHEN size(fl) <= 0 THEN null WHEN array_contains(fl, true) THEN true WHEN forall(fl, f -> f <=> false) THEN false END")
    pi = "if(try_variant_get(v, '$.message.role', 'string') = 'toolResult' AND schema_of_variant(try_variant_get(v, '$.message.isError', 'variant')) = 'BOOLEAN', try_variant_get(v, '$.message.isError', 'boolean'), null)"
    code = "try_variant_get(v, '$.item.exit_code', 'variant')"
    run = (f"CASE WHEN {J.string_sql('v', 'type')} = 'error' AND {J.string_sql('v', 'message')} IS NOT NULL OR {J.string_sql('v', 'type')} = 'turn.failed' AND {J.string_sql('v', 'error', 'message')} IS NOT NULL THEN true "
           f"WHEN {J.string_sql('v', 'type')} = 'item.completed' AND {J.string_sql('v', 'item', 'type')} = 'command_execution' AND {J.string_sql('v', 'item', 'status')} IN ('completed', 'failed') AND schema_of_variant({code}) = 'BIGINT' THEN try_variant_get({code}, '$', 'bigint') != 0 END")
    rollout = f"if({J.string_sql('v', 'type')} = 'event_msg' AND {J.string_sql('v', 'payload', 'type')} = 'error', true, null)"
    cases = {"claude-code-session@3": block, "pi-coding-agent@1": pi, "codex-exec-jsonl@1": run, "codex-rollout@1": rollout, "kimi-code-session@5": error_sql("v")}
    out = None
    for name, body in cases.items():
        out = (F.when if out is None else out.when)(profile == name, J.let_sql(value, body))
    return out


def project(events: DataFrame) -> DataFrame:
    """Actor, error flag and text of events that kept their `value` column."""
    known = F.when((F.col("profile_id") != "generic") & F.col("actor").isin("user", "assistant", "tool", "system"), F.col("actor")).otherwise("unknown")
    name = F.concat("profile_id", F.lit("@"), "profile_version")
    agent = F.when(F.col("profile_id") == "generic-agent-events", J.boolean_at(F.element_at("derived", "toolError")))
    df = J.fence(events, _c=conversation_parts(F.col("value")))
    text = F.expr("if(size(_c.parts) > 0, array_join(transform(_c.parts, p -> p.text), '\n'), null)")
    return df.select("source_id", "ordinal", "event_kind", known.alias("actor"), F.coalesce(agent, has_error(name, F.col("value"))).alias("has_error"), text.alias("text"), F.col("_c.truncated").alias("truncated"))


def trajectory_slice(rows: DataFrame, actor: str | None = None, error: bool | None = None) -> DataFrame:
    """Rows matching both; unknown never matches."""
    if actor is not None:
        rows = rows.filter((F.col("actor") == actor) & (F.col("actor") != "unknown"))
    return rows if error is None else rows.filter(F.col("has_error") == F.lit(error))


def spine(rows: DataFrame, max_tool_bytes: int = 1024) -> DataFrame:
    """T4: rows with a known actor; long or truncated tool texts are left out."""
    long = F.coalesce(F.col("truncated"), F.lit(False)) | F.coalesce(F.octet_length("text") > max_tool_bytes, F.lit(False))
    known = rows.filter(F.col("actor") != "unknown").withColumn("omitted", (F.col("actor") == "tool") & long)
    return known.withColumn("text", F.when(~F.col("omitted"), F.col("text")))


def omissions(rows: DataFrame, records: DataFrame, max_tool_bytes: int = 1024) -> DataFrame:
    """T5: what a spine leaves out, as one row."""
    tool = (F.col("actor") == "tool") & (F.col("truncated") | (F.octet_length("text") > max_tool_bytes))
    left = rows.agg(F.count_if(F.col("actor") == "unknown").alias("unknown_actor"), F.count_if(tool).alias("tool_payloads"), F.count_if("truncated").alias("truncated_text"))
    return left.join(F.broadcast(records.agg(F.count_if(F.col("parse_state") == "invalid_json").alias("invalid_json"))))


def cursor(source: Column, snapshot: Column, query: str, next_ordinal: Column) -> Column:
    """A resume point bound to source, snapshot, query and position."""
    return F.sha2(F.concat_ws("|", source, snapshot, F.sha2(F.lit(query), 256), next_ordinal.cast("string")), 256)
