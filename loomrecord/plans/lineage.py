"""Queries over lineage: transcripts, rollouts and telemetry derived from conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrecord.operators import lineage as L
from loomrecord.operators.records import parse_texts
from loomrecord.plans.registry import query, table
from loomrecord.plans.relations import agent_events
from loomrecord.plans.transcripts import build
from loomrecord.profiles import transcripts as N
from loomrecord.profiles.telemetry import TELEMETRY
from loomrecord.session import deal_rows


def transcript_events(spark, sf):
    """Each turn follows the one before; ids repeat after seven turns, the seventh turn has no session and the sixth an unknown parent."""
    rows = build(spark, sf, "transcript", """to_json(named_struct('type', if(role = 'assistant', 'assistant', 'user'), 'sessionId', if(turn = 6, null, c), 'uuid', c || '-m' || (turn % 7),
      'parentUuid', CASE WHEN turn = 5 THEN c || '-none' WHEN turn > 0 THEN c || '-m' || ((turn + 6) % 7) END, 'timestamp', iso, 'message', named_struct('role', role, 'content', text)))""")
    return N.TRANSCRIPT.project(rows, evidence=True)


def rollout_events(spark, sf):
    """Calls and results by turns; the fifth turn has no thread, calls may end in another turn, and every fourth conversation writes its last id elsewhere."""
    rows = build(spark, sf, "rollout", """to_json(named_struct('timestamp', iso, 'type', if(turn = 0, 'session_meta', 'event_msg'), 'payload', named_struct('id', if(turn = 0, c, null),
      'type', CASE WHEN turn = 0 THEN null WHEN turn % 2 = 1 THEN 'exec_command_begin' ELSE 'exec_command_end' END, 'thread_id', if(turn IN (0, 4), null, c), 'turn_id', c || '-t' || (turn div 6),
      'call_id', if(turn = 0 OR conv_id % 4 = 0 AND turn >= 5, null, c || '-k' || ((turn + 1) div 2 % 4)), 'tool_call_id', if(conv_id % 4 = 0 AND turn >= 5, c || '-k', null))))""")
    return N.ROLLOUT.project(rows, evidence=True)


def span_events(spark, sf):
    """Spans, and logs inside the span before them; some span ids and some trace ids are all zeros."""
    o = deal_rows(table(spark, sf, "orders")).withColumns({"sid": F.expr("if(o_custkey % 7 = 0, '0000', 's' || (o_orderkey - o_orderkey % 5))"), "trace": F.expr("if(o_custkey % 11 = 0, '000', 't' || (o_orderkey div 50))")})
    text = """CASE o_orderkey % 5 WHEN 0 THEN to_json(named_struct('traceId', trace, 'spanId', sid, 'parentSpanId', if(o_orderkey % 2 = 0, '00', 's' || (o_orderkey - 5)), 'name', o_orderpriority, 'startTimeUnixNano', '1700000000000000000', 'endTimeUnixNano', '1700000000000000001'))
      ELSE to_json(named_struct('timeUnixNano', '1700000000000000000', 'severityNumber', 9, 'body', named_struct('stringValue', o_orderpriority), 'traceId', trace, 'spanId', sid)) END"""
    return TELEMETRY.project(parse_texts(o.select(F.lit("otel").alias("source_id"), F.col("o_orderkey").alias("ordinal"), F.expr(text).alias("text"))), evidence=True)


TS = """ts AS (SELECT conv_id * 10 + turn AS ordinal, turn, CASE WHEN turn <> 6 THEN 'c' || conv_id END AS sess, conv_id || '-m' || (turn % 7) AS id,
    CASE WHEN turn = 5 THEN conv_id || '-none' WHEN turn > 0 THEN conv_id || '-m' || ((turn + 6) % 7) END AS par FROM conversations),
  own AS (SELECT id, count(*) FILTER (sess IS NOT NULL) AS n, min(ordinal) FILTER (sess IS NOT NULL) AS owner, bool_or(sess IS NULL) AS loose FROM ts GROUP BY 1),
  pl AS (SELECT ordinal, CASE WHEN sess IS NULL THEN 'missing-context' WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' WHEN loose THEN 'missing-context' ELSE 'unmatched' END AS status,
    CASE WHEN sess IS NOT NULL AND n = 1 THEN owner END AS partner, own.id AS parent FROM ts LEFT JOIN own ON par = own.id WHERE par IS NOT NULL)"""
RO = """ro AS (SELECT conv_id * 10 + turn AS ordinal, conv_id, turn, turn % 2 = 1 AS call, conv_id % 4 = 0 AND turn >= 5 AS elsewhere,
    CASE WHEN turn <> 4 THEN conv_id || '-t' || (turn // 6) || '-k' || ((turn + 1) // 2 % 4) END AS k FROM conversations WHERE turn > 0),
  rk AS (SELECT k, count(*) FILTER (call) AS calls, count(*) FILTER (NOT call) AS results, min(ordinal) FILTER (call) AS c, min(ordinal) FILTER (NOT call) AS r FROM ro WHERE NOT elsewhere AND k IS NOT NULL GROUP BY 1),
  tl AS (SELECT ordinal, call, CASE WHEN ro.k IS NULL THEN 'missing-context' WHEN calls = 1 AND results = 1 THEN 'matched' WHEN calls = 0 OR results = 0 THEN 'unmatched' ELSE 'ambiguous' END AS status,
    CASE WHEN calls = 1 AND results = 1 THEN CASE WHEN call THEN r ELSE c END END AS partner FROM ro LEFT JOIN rk USING (k) WHERE NOT elsewhere)"""


@query("r07_lineage_parent", f"WITH {TS} SELECT ordinal, status, partner FROM pl")
def r07(spark, sf):
    return L.lineage(transcript_events(spark, sf)).filter(F.col("relation") == "parent").select("ordinal", "status", "partner")


SP = """sp AS (SELECT o_orderkey AS ordinal, o_orderkey % 5 AS m, CASE WHEN o_custkey % 7 <> 0 THEN o_orderkey - o_orderkey % 5 END AS sid, CASE WHEN o_custkey % 11 <> 0 THEN o_orderkey // 50 END AS trace FROM orders),
  so AS (SELECT sid, trace, count(*) AS n, min(ordinal) AS owner FROM sp WHERE m = 0 AND sid IS NOT NULL AND trace IS NOT NULL GROUP BY 1, 2)"""


@query("r08_span_context", f"""WITH {SP} SELECT sp.ordinal, CASE WHEN sp.trace IS NULL THEN 'missing-context' WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN n = 1 THEN owner END AS partner
  FROM sp LEFT JOIN so ON sp.sid = so.sid AND sp.trace = so.trace WHERE m > 0 AND sp.sid IS NOT NULL""")
def r08(spark, sf):
    return L.lineage(span_events(spark, sf)).filter(F.col("relation") == "span-context").select("ordinal", "status", "partner")


@query("r08_span_parent", f"""WITH {SP}, p AS (SELECT ordinal, trace, ordinal - 5 AS par FROM sp WHERE m = 0 AND ordinal % 2 = 1) SELECT p.ordinal, CASE WHEN p.trace IS NULL THEN 'missing-context' WHEN n IS NULL THEN 'unmatched' ELSE 'matched' END AS status, owner AS partner
  FROM p LEFT JOIN so ON p.par = so.sid AND p.trace = so.trace""")
def r08b(spark, sf):
    return L.lineage(span_events(spark, sf)).filter(F.col("relation") == "parent").select("ordinal", "status", "partner")


@query("r09_lineage_tool_pairs", f"WITH {RO} SELECT ordinal, status, partner FROM tl")
def r09(spark, sf):
    return L.lineage_pairs(L.lineage_keys(rollout_events(spark, sf))).select("ordinal", "status", "partner")


@query("r10_lineage_issues", f"""WITH {TS}, {RO} SELECT 'transcript' AS source_id, ordinal, CASE status WHEN 'missing-context' THEN 'missing-parent-context' ELSE status || '-parent' END AS reason FROM pl WHERE status <> 'matched'
  UNION SELECT 'transcript', ts.ordinal, 'ambiguous-parent' FROM ts JOIN pl ON pl.parent = ts.id WHERE pl.status = 'ambiguous' AND sess IS NOT NULL
  UNION SELECT 'rollout', ordinal, CASE status WHEN 'missing-context' THEN 'missing-tool-context' ELSE status || '-tool-pair' END FROM tl WHERE status <> 'matched'
  UNION SELECT 'rollout', ordinal, 'unverified-tool-evidence' FROM ro WHERE elsewhere
  UNION SELECT 'agent-log', conv_id * 10 + turn, 'unverified-parent-evidence' FROM conversations""")
def r10b(spark, sf):
    every = transcript_events(spark, sf).unionByName(rollout_events(spark, sf)).unionByName(agent_events(spark, sf, evidence=True).select(*transcript_events(spark, sf).columns))
    return L.lineage_issues(every).select("source_id", "ordinal", "reason")


@query("r10_lineage_coverage", f"""WITH {TS} SELECT reason, count(*) AS records, reason = 'ambiguous-parent' AS ambiguous FROM (SELECT ordinal, CASE status WHEN 'missing-context' THEN 'missing-parent-context' ELSE status || '-parent' END AS reason FROM pl WHERE status <> 'matched'
  UNION SELECT ts.ordinal, 'ambiguous-parent' FROM ts JOIN pl ON pl.parent = ts.id WHERE pl.status = 'ambiguous' AND sess IS NOT NULL) GROUP BY 1""")
def r10(spark, sf):
    return L.lineage_coverage(transcript_events(spark, sf))


@query("r11_neighbourhood", f"""WITH RECURSIVE {TS}, ed AS (SELECT partner AS a, ordinal AS b, 'descendant' AS way FROM pl WHERE status = 'matched' UNION SELECT ordinal, partner, 'ancestor' FROM pl WHERE status = 'matched'),
  walk AS (SELECT 2 AS node, 0 AS distance, 'selected' AS direction UNION SELECT ed.b, distance + 1, CASE WHEN direction IN ('selected', way) THEN way ELSE 'related' END FROM walk JOIN ed ON ed.a = walk.node WHERE distance < 3)
  SELECT node, min(distance) AS distance, arg_min(direction, distance) AS direction FROM walk GROUP BY 1 ORDER BY 2, 1 LIMIT 15""")
def r11(spark, sf):
    return L.neighbourhood(L.lineage_edges(transcript_events(spark, sf)), 2)[0]


@query("r12_lookup_window", f"""WITH {TS}, {RO}, hit AS (SELECT a.ordinal, 'parent' AS relation, count(b.ordinal) AS hits, min(b.ordinal) AS hit_at FROM ts a LEFT JOIN ts b ON b.id = a.par AND b.sess IS NOT NULL AND b.ordinal BETWEEN a.ordinal - 3 AND a.ordinal - 1 WHERE a.par IS NOT NULL AND a.sess IS NOT NULL GROUP BY 1
    UNION ALL SELECT a.ordinal, 'tool-partner', count(b.ordinal), min(b.ordinal) FROM ro a LEFT JOIN ro b ON a.k = b.k AND a.call <> b.call AND NOT b.elsewhere AND ((a.call AND b.ordinal BETWEEN a.ordinal + 1 AND a.ordinal + 3) OR (b.call AND b.ordinal BETWEEN a.ordinal - 3 AND a.ordinal - 1))
      WHERE NOT a.elsewhere AND a.k IS NOT NULL GROUP BY 1)
  SELECT ordinal, relation, CASE WHEN hits = 0 THEN 'not-observed' WHEN hits = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN hits = 1 THEN hit_at END AS partner FROM hit""")
def r12(spark, sf):
    return L.lookup_window(transcript_events(spark, sf).unionByName(rollout_events(spark, sf)), 3).select("ordinal", "relation", "status", "partner")


GRAPH = f"""{TS}, {RO}, cx AS (SELECT a.ordinal, min(b.ordinal) AS owner FROM ts a JOIN ts b ON b.id = a.par AND b.sess IS NOT DISTINCT FROM a.sess GROUP BY 1 HAVING count(*) = 1),
  rt AS (SELECT ordinal, call, elsewhere, concat_ws('|', conv_id, turn = 4, turn // 6, CASE WHEN elsewhere THEN 'x' ELSE CAST((turn + 1) // 2 % 4 AS VARCHAR) END) AS k FROM ro),
  rg AS (SELECT min(ordinal) FILTER (NOT call) AS src, min(ordinal) FILTER (call) AS dst FROM rt GROUP BY k HAVING count(*) FILTER (call AND NOT elsewhere) = 1 AND count(*) FILTER (NOT call) = 1)"""


@query("r13_document_graph", f"WITH {GRAPH} SELECT 'parent' AS kind, owner AS src, ordinal AS dst FROM cx UNION ALL SELECT 'responds', src, dst FROM rg")
def r13(spark, sf):
    return L.document_graph(transcript_events(spark, sf).unionByName(rollout_events(spark, sf)))[1].select("kind", "src", "dst")


@query("r13_document_nodes", """SELECT conv_id * 10 + turn AS node, CASE WHEN turn = 0 THEN 'session' ELSE 'tool' END AS kind, CASE WHEN turn = 0 THEN 'session' WHEN turn % 2 = 1 THEN 'tool_call' ELSE 'tool_result' END AS raw_kind FROM conversations""")
def r13b(spark, sf):
    return L.document_graph(rollout_events(spark, sf))[0].select("node", "kind", "raw_kind")
