"""JSON inside prose, with the right places written out."""

import pytest

from loomrecord.functions.embedded import containers, embedded_json, outermost_json


@pytest.mark.parametrize("text, want", [
    ('see {"a":1} and [2,3].', ['{"a":1}', "[2,3]"]), ('say "{" then {"s":"}]\\\\\\"{"} end', []), ('then {"s":"}]\\"{"} end', ['{"s":"}]\\"{"}']), ('[1,{"k":2}', ['{"k":2}']),
    ('{bad [1,{"k":2}] }', ['[1,{"k":2}]']), ('[{"k":2}} {"x":[]}', ['{"k":2}', '{"x":[]}']), ("{'a':1} [NaN] {}", ["{}"]), ("[1][2][3][4][5]", ["[1]", "[2]", "[3]", "[4]"]),
    ("no json } here ]", []), ("", []), (None, []), ("é𝄞{}", ["{}"]), ('\\{"a":"\\\\"}', ['{"a":"\\\\"}'])])
def test_outermost(text, want):
    got = outermost_json(text, 4)
    assert [g["source"] for g in got] == want and all(text[g["start"]:g["end"]] == g["source"] for g in got)


def test_deep_and_long():
    assert len(containers("[" * 200_000 + "]" * 200_000)) == 200_000
    assert outermost_json("{" * 100_000 + '{"a":1}', 4) == [{"start": 100_000, "end": 100_007, "source": '{"a":1}'}]


def test_column(spark):
    df = spark.createDataFrame([("x {} [7]",), (None,), ("",)], "t string")
    assert [[tuple(f) for f in r.j] for r in df.select(embedded_json("t").alias("j")).collect()] == [[(2, 4, "{}"), (5, 8, "[7]")], [], []]
