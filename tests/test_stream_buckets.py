"""One call of the streamed relations serves many ids; lists of an id lie in parts."""

from loomrecord.streaming import incremental as X
from tests.test_stream_relations import event, run


def test_ids_share_buckets(spark):
    rows = [event(i, session=f"s{i % 40}", message=f"m{i}", parent=f"m{i - 1}") for i in range(200)]
    first, second = run(spark, [rows[100:], rows[:100]], buckets=3)
    assert len(first) == 60 + 99  # the parent of 100 is not there
    assert ("parent_child", "m99", 99, 100) in second and ("parent_child", "m98", 98, 99) in second
    assert sum(k == "session_member" for k, *_ in second) == 60 + 100 and sum(k == "parent_child" for k, *_ in second) == 199


def test_lists_in_parts(spark):
    X.Correlator.PART = 2
    try:
        calls = [event(i, "tool_call", call="k") for i in range(5)]
        first, second, third = run(spark, [calls, [event(10, "tool_result", call="k")], [event(11, "tool_result", call="k"), (None, None, *event(12, session="z")[2:]), (None, None, *event(13, session="z")[2:])]], buckets=1)
    finally:
        X.Correlator.PART = 1_000
    assert first == [] and second == [("tool_pair", "k", i, 10) for i in range(5)]
    assert sorted(set(third) - set(second)) == sorted([("session_member", "z", 12, 13), *[("tool_pair", "k", i, 11) for i in range(5)]])
