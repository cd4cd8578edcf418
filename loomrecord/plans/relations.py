"""Queries over agent events: normalising, relations, lineage, graphs, trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.operators import graph as G
from loomrecord.operators import relate as R
from loomrecord.operators.records import parse_texts
from loomrecord.plans.corpora import js, records
from loomrecord.plans.registry import query, table
from loomrecord.session import spread
from loomrecord.profiles.agents import AGENT_EVENTS


def agent_records(spark, sf):
    """One agent event per conversation turn; ids repeat, some parents come later or never."""
    c = spread(table(spark, sf, "conversations")).withColumn("c", F.expr("'c' || conv_id"))
    return records(
        c, "agent-log", F.expr("conv_id * 10 + turn"),
        event=F.expr("CASE turn % 4 WHEN 0 THEN 'user.message' WHEN 1 THEN 'tool_call' WHEN 2 THEN 'Tool-Output' ELSE 'subagent' END"),
        timestamp=F.expr("1700000000 + conv_id * 60 + turn"), role=F.col("role"),
        session_id=F.expr("CASE WHEN turn != 6 THEN c END"), turn_id=F.expr("c || '-t' || (turn div 4)"),
        message_id=F.expr("c || '-m' || (turn % 5)"),
        parent_id=F.expr("CASE WHEN turn IN (1, 6) THEN c || '-a' WHEN turn = 7 THEN c || '-none' ELSE c || '-m' || ((turn + 4) % 5) END"),
        payload=js("""to_json(named_struct('callId', CASE WHEN turn % 4 IN (1, 2) THEN c || '-k' || (turn div 4) END,
                     'agentId', CASE WHEN turn % 4 = 3 THEN c || '-a' END, 'content', text,
                     'is_error', CASE WHEN turn % 4 = 2 THEN turn > 3 END))"""),
        usage=js("""CASE WHEN role = 'assistant' THEN to_json(named_struct('input_tokens', length(text), 'output_tokens', turn)) END"""),
    )


def agent_events(spark, sf, evidence=False):
    return AGENT_EVENTS.project(parse_texts(agent_records(spark, sf)), evidence=evidence)


AG = """ag AS (SELECT conv_id * 10 + turn AS ordinal, turn, conv_id, role, text, 'c' || conv_id AS c,
  CASE turn % 4 WHEN 0 THEN 'message' WHEN 1 THEN 'tool_call' WHEN 2 THEN 'tool_result' ELSE 'subagent' END AS event_kind,
  CASE WHEN turn <> 6 THEN 'c' || conv_id END AS session_id, 'c' || conv_id || '-t' || (turn // 4) AS turn_id, 'c' || conv_id || '-m' || (turn % 5) AS message_id,
  CASE WHEN turn IN (1, 6) THEN 'c' || conv_id || '-a' WHEN turn = 7 THEN 'c' || conv_id || '-none' ELSE 'c' || conv_id || '-m' || ((turn + 4) % 5) END AS parent_id,
  CASE WHEN turn % 4 IN (1, 2) THEN 'c' || conv_id || '-k' || (turn // 4) END AS tool_call_id, CASE WHEN turn % 4 = 3 THEN 'c' || conv_id || '-a' END AS subagent_id
  FROM conversations)"""
EDGE = ("kind", "stable_id", "source_key", "target_key")


@query("n10_agent_events", f"""WITH {AG} SELECT ordinal, event_kind, role AS actor, session_id, turn_id, message_id, parent_id, tool_call_id, subagent_id,
  strftime(make_timestamp((1700000000 + conv_id * 60 + turn) * 1000000), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp_raw,
  CASE WHEN role = 'assistant' THEN length(text) END::DOUBLE AS usage_input, CASE WHEN role = 'assistant' THEN length(text) + turn END::DOUBLE AS usage_total, 'source' AS confidence FROM ag""")
def n10(spark, sf):
    return agent_events(spark, sf).select("ordinal", "event_kind", "actor", "session_id", "turn_id", "message_id", "parent_id", "tool_call_id", "subagent_id", "timestamp_raw",
                                          F.col("usage.input").alias("usage_input"), F.col("usage.total").alias("usage_total"), "confidence")


def _members(field: str) -> str:
    return f"""SELECT {field} AS stable_id, first_value(ordinal) OVER (PARTITION BY {field} ORDER BY ordinal) AS source_key, ordinal AS target_key FROM ag WHERE {field} IS NOT NULL"""


@query("r01_session_member", f"WITH {AG} SELECT 'session_member' AS kind, * FROM ({_members('session_id')}) WHERE source_key <> target_key")
def r01(spark, sf):
    return R.members(agent_events(spark, sf), "session_id", "session_member").select(*EDGE)


@query("r01_turn_member", f"WITH {AG} SELECT 'turn_member' AS kind, * FROM ({_members('turn_id')}) WHERE source_key <> target_key")
def r01b(spark, sf):
    return R.members(agent_events(spark, sf), "turn_id", "turn_member").select(*EDGE)


PARENTS = """p AS (SELECT a.ordinal AS target_key, a.event_kind AS child_kind, a.parent_id AS stable_id,
    (SELECT max(m.ordinal) FROM ag m WHERE m.message_id = a.parent_id AND m.ordinal <= a.ordinal) AS pm,
    (SELECT max(m.ordinal) FROM ag m WHERE m.subagent_id = a.parent_id AND m.ordinal <= a.ordinal) AS ps,
    (SELECT min(m.ordinal) FROM ag m WHERE m.message_id = a.parent_id AND m.ordinal > a.ordinal) AS lm,
    (SELECT min(m.ordinal) FROM ag m WHERE m.subagent_id = a.parent_id AND m.ordinal > a.ordinal) AS ls FROM ag a)"""


@query("r02_parent_child", f"""WITH {AG}, {PARENTS} SELECT CASE WHEN COALESCE(pm, ps) IS NOT NULL THEN 'parent_child' WHEN lm IS NULL OR ls < lm OR child_kind = 'subagent' THEN 'subagent_parent' ELSE 'parent_child' END AS kind,
  stable_id, COALESCE(pm, ps, least(lm, ls)) AS source_key, target_key FROM p WHERE COALESCE(pm, ps, lm, ls) IS NOT NULL""")
def r02(spark, sf):
    return R.parents(agent_events(spark, sf)).select(*EDGE)


@query("r03_subagent_parent", f"""WITH {AG}, {PARENTS} SELECT stable_id, least(lm, ls) AS source_key, target_key FROM p WHERE COALESCE(pm, ps) IS NULL AND COALESCE(lm, ls) IS NOT NULL
  AND (lm IS NULL OR ls < lm OR child_kind = 'subagent')""")
def r03(spark, sf):
    return R.parents(agent_events(spark, sf)).filter(F.col("kind") == "subagent_parent").select("stable_id", "source_key", "target_key")


@query("r04_tool_pair", f"""WITH {AG} SELECT 'tool_pair' AS kind, a.tool_call_id AS stable_id, a.ordinal AS source_key, b.ordinal AS target_key FROM ag a JOIN ag b ON a.tool_call_id = b.tool_call_id
  WHERE a.event_kind = 'tool_call' AND b.event_kind = 'tool_result'""")
def r04(spark, sf):
    return R.tool_pairs(agent_events(spark, sf)).select(*EDGE)


@query("r05_relation_evidence", f"""WITH {AG} SELECT a.ordinal AS source_key, b.ordinal AS target_key, CASE WHEN a.session_id IS NULL THEN '$.turn_id,$.message_id' ELSE '$.session_id,$.turn_id' END || ',' ||
  CASE WHEN b.session_id IS NULL THEN '$.turn_id,$.message_id' ELSE '$.session_id,$.turn_id' END AS paths
  FROM ag a JOIN ag b ON a.tool_call_id = b.tool_call_id WHERE a.event_kind = 'tool_call' AND b.event_kind = 'tool_result'""")
def r05(spark, sf):
    e = agent_events(spark, sf, evidence=True)
    edges = R.tool_pairs(e)
    out = R.relation_evidence(edges.unionByName(edges), e)
    return out.select("source_key", "target_key", F.expr("array_join(transform(evidence, x -> x.path), ',')").alias("paths"))


@query("r06_profile_scope", f"""WITH {AG}, tagged AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS profile_id FROM ag)
  SELECT profile_id, count(*) AS edges FROM (SELECT profile_id, session_id, ordinal, min(ordinal) OVER (PARTITION BY profile_id, session_id) AS first FROM tagged WHERE session_id IS NOT NULL)
  WHERE ordinal <> first GROUP BY 1""")
def r06(spark, sf):
    e = agent_events(spark, sf).withColumn("profile_id", F.expr("if(ordinal % 10 % 2 = 0, 'even', 'odd')"))
    return R.relations(e).filter(F.col("kind").isin("session_member")).groupBy("profile_id").agg(F.count(F.lit(1)).alias("edges"))


@query("e03_evidence_rows", f"""WITH {AG} SELECT field, path, count(*) AS n FROM (SELECT unnest(['event_kind', 'actor', 'turn_id', 'message_id', 'parent_id']) AS field, unnest(['$.event', '$.role', '$.turn_id', '$.message_id', '$.parent_id']) AS path FROM ag
  UNION ALL SELECT 'session_id', '$.session_id' FROM ag WHERE session_id IS NOT NULL UNION ALL SELECT 'tool_call_id', '$.payload.callId' FROM ag WHERE tool_call_id IS NOT NULL
  UNION ALL SELECT 'subagent_id', '$.payload.agentId' FROM ag WHERE subagent_id IS NOT NULL) GROUP BY 1, 2""")
def e03(spark, sf):
    return R.evidence_rows(agent_events(spark, sf, evidence=True)).groupBy("field", "path").agg(F.count(F.lit(1)).alias("n"))


@query("e04_usage_by_session", f"WITH {AG} SELECT session_id AS key, sum(length(text))::DOUBLE AS input, sum(turn)::DOUBLE AS output, NULL::DOUBLE AS cached, sum(length(text) + turn)::DOUBLE AS total, count(*) AS events FROM ag WHERE role = 'assistant' GROUP BY 1")
def e04(spark, sf):
    return R.usage_by(agent_events(spark, sf), "session_id")


# ---- graphs over the star schema -------------------------------------------------


def supply_graph(spark, sf):
    """Suppliers and parts as nodes; order lines as edges, with repeats and dangling ends."""
    li = table(spark, sf, "lineitem")
    nodes = table(spark, sf, "supplier").select(F.expr("'s' || s_suppkey").alias("id"), F.col("s_suppkey").alias("seq")).unionByName(
        table(spark, sf, "part").filter("p_partkey % 10 != 3").select(F.expr("'p' || p_partkey").alias("id"), (F.col("p_partkey") + 1_000_000_000).alias("seq")))
    nodes = nodes.unionByName(table(spark, sf, "nation").select(F.expr("'s' || n_nationkey").alias("id"), (F.col("n_nationkey") + 2_000_000_000).cast("bigint").alias("seq")))
    edges = li.select(F.expr("'s' || l_suppkey || '-p' || l_partkey").alias("id"), F.expr("'s' || l_suppkey").alias("src"), F.expr("'p' || l_partkey").alias("dst"),
                      (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return nodes, edges.groupBy("id", "src", "dst", "seq").agg(F.count(F.lit(1)).alias("copies")).drop("copies")


@query("r14_build_graph", """WITH e0 AS (SELECT DISTINCT 's' || l_suppkey || '-p' || l_partkey AS id, l_suppkey AS s, l_partkey AS p, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
  e1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM e0), e2 AS (SELECT * FROM e1 WHERE rn = 1), e3 AS (SELECT * FROM e2 WHERE p % 10 <> 3 AND s IN (SELECT s_suppkey FROM supplier UNION SELECT n_nationkey FROM nation) AND p IN (SELECT p_partkey FROM part)),
  e4 AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY seq, id) AS rs, row_number() OVER (PARTITION BY p ORDER BY seq, id) AS rp FROM e3)
  SELECT 'duplicate-edge' AS code, (SELECT count(*) FROM e1 WHERE rn > 1) AS n UNION ALL SELECT 'missing-endpoint', (SELECT count(*) FROM e2) - (SELECT count(*) FROM e3)
  UNION ALL SELECT 'degree-limit', (SELECT count(*) FROM e4 WHERE rs > 64 OR rp > 64) UNION ALL SELECT 'kept', (SELECT count(*) FROM e4 WHERE rs <= 64 AND rp <= 64)
  UNION ALL SELECT 'duplicate-node', (SELECT count(*) FROM nation WHERE n_nationkey IN (SELECT s_suppkey FROM supplier))""")
def r14(spark, sf):
    nodes, kept, bad = G.build_graph(*supply_graph(spark, sf))
    return bad.groupBy("code").agg(F.count(F.lit(1)).alias("n")).unionByName(kept.agg(F.lit("kept").alias("code"), F.count(F.lit(1)).alias("n")))


@query("r15_cycles", """WITH n AS (SELECT conv_id, max(turn) AS m FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1)
  SELECT conv_id * 10 + turn - 1 AS src, conv_id * 10 + turn AS dst FROM conversations WHERE turn > 0 AND conv_id % 3 = 0 UNION SELECT conv_id * 10 + m, conv_id * 10 FROM n""")
def r15(spark, sf):
    """Turns in a row; in every third conversation the last leads back to the first, elsewhere the chain just ends."""
    c = table(spark, sf, "conversations")
    chain = c.filter("turn > 0").select(F.expr("conv_id * 10 + turn - 1").alias("src"), F.expr("conv_id * 10 + turn").alias("dst"))
    back = c.filter("conv_id % 3 = 0").groupBy("conv_id").agg(F.max("turn").alias("m")).select(F.expr("conv_id * 10 + m").alias("src"), F.expr("conv_id * 10").alias("dst"))
    return G.cycles(chain.unionByName(back))


@query("w06_closure", """WITH RECURSIVE w AS (SELECT conv_id * 10 AS node, 0 AS depth FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id * 10 + c.turn, w.depth + 1 FROM w JOIN conversations c ON c.conv_id * 10 + c.turn - 1 = w.node AND c.turn > 0) SELECT node, depth FROM w""")
def w06(spark, sf):
    c = table(spark, sf, "conversations").select(F.expr("conv_id * 10 + turn").alias("dst"), "turn")
    edges = c.filter("turn > 0").select((F.col("dst") - 1).alias("src"), "dst")
    return G.closure(edges, c.filter("turn = 0").select(F.col("dst").alias("node")))
