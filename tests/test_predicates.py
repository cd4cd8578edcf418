"""Every operator against every kind of value, compared with a plain Python reading of the rules."""

import json

import pytest

from loomrecord.operators import where as W
from loomrecord.operators.records import parse_texts

MISSING = object()
VALUES = [MISSING, None, True, False, 0, 1, 1.0, 1.5, -2, "", "1", "a", "Ab", "b", [], [1], {}, {"k": 1}]
LITERALS = [None, True, 0, 1, 1.5, "1", "a", "b"]


def number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def expected(op, v, lit):
    if v is MISSING:
        return False
    same = (number(v) and number(lit) and v == lit) or (type(v) is type(lit) and not isinstance(v, (list, dict)) and v == lit)
    if op == "eq":
        return same
    if op == "ne":
        return not same
    if (number(v) and number(lit)) or (isinstance(v, str) and isinstance(lit, str)):
        return {"lt": v < lit, "lte": v <= lit, "gt": v > lit, "gte": v >= lit}[op]
    return False


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, json.dumps({} if v is MISSING else {"f": v})) for i, v in enumerate(VALUES)] + [(99, "{broken")]
    return parse_texts(spark.createDataFrame(data, "i int, text string")).cache()


@pytest.mark.parametrize("op", ["eq", "ne", "lt", "lte", "gt", "gte"])
def test_comparison_matrix(rows, op):
    trees = {f"c{k}": {"op": op, "path": ["f"], "value": lit} for k, lit in enumerate(LITERALS)}
    got = rows.filter("i < 99").select("i", *[W.condition(t).alias(n) for n, t in trees.items()]).collect()
    for row in got:
        for k, lit in enumerate(LITERALS):
            assert row[f"c{k}"] == expected(op, VALUES[row.i], lit), (op, VALUES[row.i], lit)


def test_not_matches_missing_but_never_unparsed(rows):
    hit = {r.i for r in W.where(rows, {"op": "not", "arg": {"op": "eq", "path": ["f"], "value": "a"}}).collect()}
    assert hit == set(range(len(VALUES))) - {VALUES.index("a")}


def test_text_ops_and_presence(rows):
    def ids(tree):
        return [VALUES[r.i] for r in W.where(rows, tree).orderBy("i").collect()]
    assert ids({"op": "contains", "path": ["f"], "value": "A", "ignore_case": True}) == ["a", "Ab"]
    assert ids({"op": "starts_with", "path": ["f"], "value": "A"}) == ["Ab"]
    assert ids({"op": "ends_with", "path": ["f"], "value": "b"}) == ["Ab", "b"]
    assert ids({"op": "is_null", "path": ["f"]}) == [None]
    assert len(ids({"op": "exists", "path": ["f"]})) == len(VALUES) - 1
    assert [type(x) for x in ids({"op": "kind_is", "path": ["f"], "value": "integer"})] == [int, int, float, int]
