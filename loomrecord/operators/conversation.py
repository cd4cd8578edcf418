"""E2 at any depth: the visible texts of a record, by walking its known slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.operators.trajectory import _opaque

# Slots that hold messages, slots that hold a text, and envelopes, each in the order in which they are tried.
MESSAGE_SLOTS = ["messages", "conversations", "message", "content", "parts"]
TEXT_SLOTS = ["text", "think", "thinking", "reasoning", "value", "body", "delta", "aggregated_output"]
THOUGHTS = ["think", "thinking", "reasoning"]
ENVELOPES = ["payload", "item", "event", "part", "data", "params", "result"]
# Dataset slots with the role and label of each, and names of roles.
DATASET_SLOTS = {
    "instruction": ("user", "Instruction"), "prompt": ("user", "Prompt"), "question": ("user", "Question"), "context": ("context", "Context"), "input": ("user", "Input"),
    "output": ("assistant", "Response"), "response": ("assistant", "Response"), "completion": ("assistant", "Completion"), "answer": ("assistant", "Answer"), "chosen": ("assistant", "Chosen"),
    "rejected": ("assistant", "Rejected"), "chosen_messages": ("assistant", "Chosen"), "rejected_messages": ("assistant", "Rejected"),
}
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "observation": "tool"}


def nesting(value: Column) -> Column:
    """How many containers deep a VARIANT goes: 0 for a scalar."""
    flat = F.regexp_replace(F.to_json(value), r"\\.", "x")
    brackets = F.regexp_replace(F.regexp_replace(flat, r'"[^"]*+"', ""), r"[^\[\]{}]", "")
    deep = "aggregate(split(b, ''), named_struct('now', 0, 'most', 0), (s, c) -> named_struct('now', s.now + CASE WHEN c IN ('[', '{') THEN 1 WHEN c IN (']', '}') THEN -1 ELSE 0 END, 'most', greatest(s.most, s.now + if(c IN ('[', '{'), 1, 0))), s -> s.most)"
    return J.let_sql(brackets, deep, "b")


def _child(node: str, path: str, role: str, label: str) -> str:
    return f"named_struct('node', {node}, 'path', {path}, 'role', {role}, 'label', {label}, 'text', cast(null AS string), 'done', false)"


def _next_sql() -> str:
    """What a place `n` of the walk becomes in one step: itself when done, else the places it leads to, in order."""
    def at(key: str) -> str:
        return J.get_sql("n.node", key)
    def step(key: str, role: str = "r", label: str = "n.label") -> str:
        return _child(at(key), f"concat(n.path, '.{key}')", role, label)
    def is_text(key: str) -> str:
        return f"schema_of_variant({at(key)}) = 'STRING'"
    table = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in ROLES.items()) + ")"
    said = f"coalesce({', '.join(f"if(schema_of_variant({at(k)}) = 'STRING', try_variant_get({at(k)}, '$', 'string'), null)" for k in ('role', 'from'))}, n.role)"
    role = J.bind_sql(said, "e", f"coalesce(element_at({table}, e), e)")
    slots = []
    for key, (who, label) in DATASET_SLOTS.items():
        own = step(key, f"'{who}'", f"'{label}'")
        if key == "output":
            own = f"if(r = 'tool' OR n.label = 'tool_result', {step(key, "'tool'", "'Tool result'")}, {own})"
        slots.append(f"if({is_text(key)} OR try_variant_get({at(key)}, '$', 'array<variant>') IS NOT NULL, {own}, null)")
    cases = " ".join(f"WHEN {at(k)} IS NOT NULL THEN array({step(k)})" for k in MESSAGE_SLOTS)
    cases += " " + " ".join(f"WHEN {is_text(k)} THEN array({step(k, "'reasoning'", "'Reasoning'") if k in THOUGHTS else step(k)})" for k in TEXT_SLOTS)
    data = f"filter(array({', '.join(slots)}), x -> x IS NOT NULL)"
    wraps = " ".join(f"WHEN try_variant_get({at(k)}, '$', 'map<string,variant>') IS NOT NULL THEN array({step(k)})" for k in ENVELOPES)
    inside = f"CASE {cases} ELSE {J.bind_sql(data, 'd', f'CASE WHEN size(d) > 0 THEN d {wraps} ELSE slice(d, 1, 0) END')} END"
    closed = "named_struct('node', n.node, 'path', n.path, 'role', n.role, 'label', n.label, 'text', {0}, 'done', true)"
    # Only scalars are asked for their schema as a whole: that of a container is as long as the container.
    items = f"transform(try_variant_get(n.node, '$', 'array<variant>'), (x, i) -> {_child('x', "concat(n.path, '[', i, ']')", 'n.role', 'n.label')})"
    thing = f"if({_opaque('n.node')}, array({closed.format('cast(null AS string)')}), {J.bind_sql(role, 'r', inside)})"
    text = f"if(schema_of_variant(n.node) = 'STRING', array({closed.format("try_variant_get(n.node, '$', 'string')")}), array())"
    return f"CASE WHEN n.done THEN array(n) WHEN try_variant_get(n.node, '$', 'array<variant>') IS NOT NULL THEN {items} WHEN try_variant_get(n.node, '$', 'map<string,variant>') IS NOT NULL THEN {thing} ELSE {text} END"


def conversation_walk(value: Column, actor: Column | None = None, kind: Column | None = None, max_parts: int | None = None, max_chars: int | None = None) -> Column:
    """STRUCT<parts ARRAY<STRUCT<role,label,text,path>>, truncated> of a record's visible texts, in order, at any depth.

    A string is shown; a list is walked; an object leads to its first message slot, else its first
    text slot, else all its dataset slots, else its first envelope. `role` or `from` of an
    object speaks for what is below it; `actor` and `kind` of the event for the rest. Hidden, encrypted
    and media items show nothing and count as truncation. `max_parts` bounds the parts,
    `max_chars` the characters that they share in order; by default all is shown. Null and
    scalar records other than strings have no parts.

    The walk is a loop inside the row, one round for each level, over the places reached so far.
    """
    start = f"array({_child('o.v', "'$'", "coalesce(o.actor, 'unknown')", "coalesce(o.kind, 'Record')")})"
    walked = f"aggregate(sequence(0, o.deep), {start}, (state, i) -> flatten(transform(state, n -> {_next_sql()})))"
    texts = "transform(filter(a, p -> p.text != ''), p -> named_struct('role', left(coalesce(nullif(p.role, ''), 'unknown'), 32), 'label', left(coalesce(nullif(p.label, ''), 'Record'), 40), 'text', p.text, 'path', p.path))"
    shown = "t" if max_parts is None else f"slice(t, 1, {int(max_parts)})"
    over = ["exists(a, p -> p.text IS NULL)"] + ([] if max_parts is None else [f"size(t) > {int(max_parts)}"])
    if max_chars is not None:
        cut = "named_struct('role', p.role, 'label', p.label, 'text', left(p.text, s.rest), 'path', p.path)"
        shown = (f"filter(aggregate({shown}, named_struct('rest', {int(max_chars)}, 'out', slice(t, 1, 0)), (s, p) -> named_struct('rest', greatest(0, s.rest - length(p.text)), 'out', concat(s.out, array({cut}))), s -> s.out), p -> p.text != '')")
        over.append(f"aggregate(t, 0, (n, p) -> n + length(p.text)) > {int(max_chars)}")
    body = J.bind_sql(walked, "a", J.bind_sql(texts, "t", f"named_struct('parts', {shown}, 'truncated', {' OR '.join(over)})"))
    nothing = F.lit(None).cast("string")
    row = F.struct(value.alias("v"), nesting(value).alias("deep"), (nothing if actor is None else actor).alias("actor"), (nothing if kind is None else kind).alias("kind"))
    return F.when(value.isNotNull(), J.let_sql(row, body, "o"))
