"""Relations of a stream against those of the whole, redelivery, and expiry."""

import random

from pyspark.sql import functions as F

from loomrecord.operators import relate as R
from loomrecord.session import scratch_dir
from loomrecord.streaming import incremental as X

SCHEMA = "source_id string, profile_id string, ordinal long, event_kind string, session_id string, turn_id string, message_id string, parent_id string, tool_call_id string, subagent_id string, ts timestamp"


def run(spark, deliveries, **how):
    """Edges after each delivery; every delivery is one trigger of the same stream."""
    base, out = scratch_dir(spark), []
    for n, rows in enumerate(deliveries):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{base}/in/d{n}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        q = X.stream_relations(stream, **how).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.read.schema(X.EDGES).parquet(f"{base}/out")
        out.append(sorted((r.kind, r.stable_id, r.source_key, r.target_key) for r in got.collect()))
    return out


def event(n, kind="message", session=None, turn=None, message=None, parent=None, call=None, agent=None):
    return ("s", "p", n, kind, session, turn, message, parent, call, agent, None)


def test_whole_equals_increments(spark):
    rnd = random.Random(4)
    kinds = ["message", "tool_call", "tool_result", "subagent", "action", "observation"]
    pick = lambda *x: rnd.choice([None, *x])
    rows = [event(i, rnd.choice(kinds), pick("hot", "hot", "a"), pick("t1", "t2"), pick("m1", "m2", f"m{i % 9}"), pick("m1", "m3", "m5", "g1", "none"), pick("k1", "k2"), pick("g1", "g2")) for i in range(150)]
    whole = sorted((r.kind, r.stable_id, r.source_key, r.target_key) for r in R.relations(spark.createDataFrame(rows, SCHEMA)).collect())
    first, second, again = run(spark, [rows[:60], rows[40:], rows[20:90]])
    assert set(first) < set(whole) and second == whole and again == whole  # rows 40-59 and all of the third come twice


def test_children_wait_for_their_parent(spark):
    first, second, third = run(spark, [[event(5, parent="m"), event(6, "subagent", parent="m"), event(7, "tool_result", call="k")], [event(1, message="m"), event(2, "tool_call", call="k")], [event(9, parent="m"), event(10, agent="m"), event(11, message="m"), event(12, parent="m")]])
    assert first == []
    assert second == [("parent_child", "m", 1, 5), ("subagent_parent", "m", 1, 6), ("tool_pair", "k", 2, 7)]
    assert third == sorted([*second, ("parent_child", "m", 1, 9), ("parent_child", "m", 11, 12)])


def test_state_expires(spark):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else availableNow runs on for the timers
    first, second = run(spark, [[event(1, session="s"), event(2, session="s")], [event(3, session="s"), event(4, session="s")]], ttl_ms=1)
    assert first == [("session_member", "s", 1, 2)] and second == [("session_member", "s", 1, 2), ("session_member", "s", 3, 4)]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
