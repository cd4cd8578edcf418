"""Typed predicates over dynamic JSON, built as Columns from a predicate tree.

A tree is a nested dict, for instance::

    {"op": "and", "args": [
        {"op": "eq", "path": ["level"], "value": "error"},
        {"op": "not", "arg": {"op": "exists", "path": ["user"]}}]}

Every leaf is two-valued, so NOT is plain negation: a missing field makes
``not eq`` true. Records that did not parse match nothing, not even under NOT.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J

TEXT_OPS = {"contains": "contains", "starts_with": "startswith", "ends_with": "endswith"}
ORDER_OPS = {
    "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
}
# Normalised event columns a profile predicate may name; others are derived fields.
EVENT_FIELDS = [
    "event_kind", "timestamp_raw", "actor", "session_id", "turn_id", "parent_id", "message_id", "tool_call_id",
    "subagent_id", "model", "status", "severity", "summary", "confidence", "profile_id", "profile_version",
]
USAGE_FIELDS = ["usage.input", "usage.output", "usage.cached", "usage.total"]


def _sure(expr: Column) -> Column:
    return F.coalesce(expr, F.lit(False))


def equals(leaf: Column, literal: Any) -> Column:
    """strict equality without coercion; null equals a present null."""
    if literal is None:
        return J.is_json_null(leaf)
    if isinstance(literal, bool):
        return _sure(J.is_boolean(leaf) & (F.try_variant_get(leaf, "$", "boolean") == F.lit(literal)))
    if isinstance(literal, (int, float)):
        return _sure(J.is_numeric(leaf) & (J.as_double(leaf) == F.lit(float(literal))))
    return _sure(J.is_string(leaf) & (J.as_string(leaf) == F.lit(literal)))


def ordered(leaf: Column, op: str, literal: Any) -> Column:
    """Number with number or string with string; any other pair is false."""
    compare = ORDER_OPS[op]
    if isinstance(literal, bool) or literal is None:
        return F.lit(False)
    if isinstance(literal, (int, float)):
        return _sure(J.is_numeric(leaf) & compare(J.as_double(leaf), F.lit(float(literal))))
    return _sure(J.is_string(leaf) & compare(J.as_string(leaf), F.lit(literal)))


def _text_match(text: Column, op: str, needle: str, ignore_case: bool) -> Column:
    if ignore_case:
        text, needle_col = F.lower(text), F.lower(F.lit(needle))
    else:
        needle_col = F.lit(needle)
    return getattr(text, TEXT_OPS[op])(needle_col)


def text_op(leaf: Column, op: str, needle: str, ignore_case: bool = False) -> Column:
    """Strings only."""
    return _sure(J.is_string(leaf) & _text_match(J.as_string(leaf), op, needle, ignore_case))


def text_search(text: Column, value: Column, needle: str, paths: list[list] | None = None, ignore_case: bool = True) -> Column:
    """Substring of the searchable text of the record or of any listed path."""
    bodies = [J.searchable_text(text, value, *p) for p in (paths or [[]])]
    return reduce(lambda a, b: a | b, [_sure(_text_match(b, "contains", needle, ignore_case)) for b in bodies])


def event_field(name: str) -> tuple[str, Column]:
    """('string'|'number'|'variant', column) of a normalised field or a derived one."""
    if name in EVENT_FIELDS:
        return "string", F.col(name)
    if name in USAGE_FIELDS:
        return "number", F.col(name)
    return "variant", F.element_at(F.col("derived"), name)


def _event_compare(name: str, op: str, literal: Any) -> Column:
    typ, col = event_field(name)
    if typ == "variant":
        same = equals(col, literal)
        if op == "eq":
            return same
        if op == "ne":
            return col.isNotNull() & ~same
        return ordered(col, op, literal)
    numeric = isinstance(literal, (int, float)) and not isinstance(literal, bool)
    fits = (typ == "number" and numeric) or (typ == "string" and isinstance(literal, str))
    if op == "eq":
        return _sure(col == F.lit(literal)) if fits else F.lit(False)
    if op == "ne":
        return col.isNotNull() & (~_sure(col == F.lit(literal)) if fits else F.lit(True))
    return _sure(ORDER_OPS[op](col, F.lit(literal))) if fits else F.lit(False)


def condition(tree: dict, text: str = "text", value: str = "value") -> Column:
    """Build the two-valued Column for a predicate tree."""
    op = tree["op"]
    v = F.col(value)
    if op in ("and", "or"):
        args = [condition(t, text, value) for t in tree["args"]]
        if not args:
            return F.lit(op == "and")
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), args)
    if op == "not":
        return ~condition(tree["arg"], text, value)
    if op == "text_search":
        return text_search(F.col(text), v, tree["value"], tree.get("paths"), tree.get("ignore_case", True))
    if op == "profile_field":
        return _event_compare(tree["field"], tree["compare"], tree["value"])
    if op == "profile_text":
        typ, col = event_field(tree["field"])
        ignore = tree.get("ignore_case", False)
        if typ == "variant":
            return text_op(col, tree["match"], tree["value"], ignore)
        return _sure(_text_match(col, tree["match"], tree["value"], ignore)) if typ == "string" else F.lit(False)
    if op == "profile_exists":
        return event_field(tree["field"])[1].isNotNull()
    if op == "profile_is_null":
        typ, col = event_field(tree["field"])
        return J.is_json_null(col) if typ == "variant" else F.lit(False)
    leaf = J.get(v, *tree["path"])
    if op == "eq":
        return equals(leaf, tree["value"])
    if op == "ne":
        return leaf.isNotNull() & ~equals(leaf, tree["value"])
    if op in ORDER_OPS:
        return ordered(leaf, op, tree["value"])
    if op in TEXT_OPS:
        return text_op(leaf, op, tree["value"], tree.get("ignore_case", False))
    if op == "exists":
        return leaf.isNotNull()
    if op == "is_null":
        return J.is_json_null(leaf)
    if op == "kind_is":
        return _sure(J.kind(leaf) == F.lit(tree["value"]))
    raise ValueError(f"unknown predicate {op!r}")


def where(df: DataFrame, tree: dict, text: str = "text", value: str = "value") -> DataFrame:
    """Rows that parsed and match the tree."""
    return df.filter(F.col(value).isNotNull() & condition(tree, text, value))


def column_filter(path: list, kind: str, operator: str, operand: Any) -> dict | None:
    """a column filter as a predicate; unsupported combinations are no filter."""
    if operator == "empty":
        return {"op": "or", "args": [{"op": "not", "arg": {"op": "exists", "path": path}}, {"op": "is_null", "path": path}]}
    if operator == "not_empty":
        return {"op": "and", "args": [{"op": "exists", "path": path}, {"op": "not", "arg": {"op": "is_null", "path": path}}]}
    if kind == "text" and isinstance(operand, str) and operand:
        if operator in TEXT_OPS:
            return {"op": operator, "path": path, "value": operand, "ignore_case": True}
        if operator == "not_contains":
            return {"op": "not", "arg": {"op": "contains", "path": path, "value": operand, "ignore_case": True}}
        if operator in ("eq", "ne"):
            return {"op": operator, "path": path, "value": operand}
    if kind == "number" and isinstance(operand, (int, float)) and not isinstance(operand, bool):
        if operator in ORDER_OPS or operator in ("eq", "ne"):
            return {"op": operator, "path": path, "value": operand}
    if kind == "boolean" and isinstance(operand, bool) and operator in ("eq", "ne"):
        return {"op": operator, "path": path, "value": operand}
    return None


def row_types(path: list, values: list) -> dict:
    """any of the values of one discriminator."""
    return {"op": "or", "args": [{"op": "eq", "path": path, "value": x} for x in values]}


def compose(*parts: dict | None) -> dict:
    """text AND column filters AND row types; absent parts do not restrict."""
    return {"op": "and", "args": [p for p in parts if p is not None]}
