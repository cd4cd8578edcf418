"""Small cases that once gave wrong results, with the right rows written out by hand."""

from pyspark.sql import functions as F

from loomrecord.operators import catalog as C
from loomrecord.operators import dataset as D
from loomrecord.operators import graph as G
from loomrecord.operators import insights as I
from loomrecord.operators import page as P
from loomrecord.operators import trajectory as T


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_long_chains_are_no_cycles(spark):
    chain = [(i, i + 1) for i in range(140)]
    df = spark.createDataFrame([*chain, (1000, 1001), (1001, 1002), (1002, 1000), (2000, 2000)], "src long, dst long")
    assert rows(G.cycles(df), "src", "dst") == [(1000, 1001), (1001, 1002), (1002, 1000), (2000, 2000)]


def test_closure_has_no_depth_limit(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 3)], "src long, dst long")
    root = spark.createDataFrame([(0,)], "node long")
    assert rows(G.closure(df, root), "node", "depth") == [(i, i) for i in range(13)]
    assert rows(G.closure(df, root, 2), "node", "depth") == [(0, 0), (1, 1), (2, 2)]


def test_refused_edges_use_up_no_degree(spark):
    nodes = spark.createDataFrame([("h", 0), ("a", 1), ("b", 2), ("c", 3), ("d", 4)], "id string, seq long")
    # h takes e1 and e2; e3 is refused there and so leaves room at c for e4 and e5.
    edges = spark.createDataFrame([("e1", "h", "a", 1), ("e2", "h", "b", 2), ("e3", "h", "c", 3), ("e4", "c", "d", 4), ("e5", "c", "a", 5), ("e6", "c", "b", 6)], "id string, src string, dst string, seq long")
    _, kept, bad = G.build_graph(nodes, edges, 2)
    assert rows(kept, "id") == [("e1",), ("e2",), ("e4",), ("e5",)]
    assert rows(bad, "code", "id") == [("degree-limit", "e3"), ("degree-limit", "e6")]


def test_page_keeps_one_oversized_row_only_at_the_start(spark):
    df = spark.createDataFrame([("s", 0, 0), ("s", 1, 500), ("t", 0, 500), ("t", 1, 1)], "source_id string, ordinal long, content_len long")
    assert rows(P.within_bytes(df, 100), "source_id", "ordinal") == [("s", 0), ("t", 0)]


def test_children_without_times_stay_on_later_pages(spark):
    e = spark.createDataFrame([("s", f"n{i}", "p", f"T{i}", None, None if i > 2 else 10 - i, 5 if i == 4 else None) for i in range(6)],
                              "source_id string, native_id string, parent_native_id string, label string, vendor_title string, activity_ms long, started_ms long")
    mine, seen, after = F.col("parent_native_id") == "p", [], None
    while True:
        page = C.children_page(e, mine, "activity", 2, after).orderBy(F.col("sort_value").desc(), "native_id").collect()
        seen += [r.native_id for r in page]
        if not page[-1].has_more:
            break
        after = (page[-1].sort_value, page[-1].native_id)
    assert seen == ["n0", "n1", "n2", "n4", "n3", "n5"]


def test_deleted_collections_stay_deleted(spark):
    log = spark.createDataFrame(
        [("q1", 1, "create", "k", None, "one"), ("q2", 2, "delete", "k", None, None), ("q3", 3, "rename", "k", None, "zombie"), ("q4", 4, "add", "k", "e", None), ("q5", 5, "rename", "never", None, "x"),
         ("q6", 6, "create", "m", None, "first"), ("q7", 7, "add", "m", "e", None), ("q8", 8, "delete", "m", None, None), ("q9", 9, "create", "m", None, "second"), ("q10", 10, "create", "m", None, "again")],
        "request_id string, revision long, op string, collection_id string, entry_id string, text string")
    assert rows(C.collection_counts(C.fold_commands(log)), "collection_id", "name", "entries") == [("m", "second", 0)]


def test_whole_arrays_are_observed(spark):
    tokens = ", ".join(["1"] * 599 + ["-100"] + ["0.5"])
    messages = ", ".join(['{"role": "user", "content": "x"}'] * 79 + ['{"role": "assistant", "content": "y"}'])
    df = spark.sql(f"SELECT 's' AS source_id, 1L AS ordinal, parse_json('{{\"input_ids\": [{tokens}], \"messages\": [{messages}]}}') AS value")
    full, cut = D.record_summary(df).first(), D.record_summary(df, limits=D.Limits(messages=64, tokens=512)).first()
    assert (full.observed, full.role_assistant, full.target, full.truncated) == (80, 1, "present", False)
    assert [(s.negative100, s.non_integer, s.length) for s in full.sequences] == [(1, 1, 601)]
    assert (cut.observed, cut.role_assistant, cut.target, cut.truncated) == (64, 0, "unknown", True) and cut.sequences[0].negative100 == 0


def test_hidden_and_media_blocks_show_no_text(spark):
    value = ('{"role": "user", "content": ["a", {"type": "text", "text": "b"}, {"type": "text", "text": "h", "hidden": true}, {"text": "c", "encrypted": ""}, {"type": "input_image", "text": "url"}, '
             '{"type": "thinking", "thinking": "t"}]}')
    df = spark.sql(f"SELECT parse_json('{value}') AS v")
    got = df.select(T.conversation_parts(F.col("v")).alias("c"), T.conversation_parts(F.col("v"), 2, 1).alias("d")).first()
    assert [(p.label, p.text) for p in got.c.parts] == [("text", "a"), ("text", "b"), ("reasoning", "t")] and got.c.truncated
    assert [p.text for p in got.d.parts] == ["a"]


def test_first_seen_goes_by_source_then_ordinal(spark):
    df = spark.createDataFrame([("b", 1, "late"), ("a", 7, "early"), ("a", 9, "mid"), ("b", 2, "early")], "source_id string, ordinal long, k string")
    got = [(r.label, r["count"]) for r in I.category_counts(df, I.select_text(F.col("k")), max_groups=5).collect()]
    assert got == [("early", 2), ("mid", 1), ("Other", 1)]
