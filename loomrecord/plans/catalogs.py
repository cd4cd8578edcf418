"""Catalog and collection queries: regions, nations, customers and orders stand in for sources and sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loomrecord.operators import catalog as C
from loomrecord.plans.registry import query, table
from loomrecord.plans.relations import AG, agent_events


def entities(spark, sf):
    """Customers below nations; some parents are declared but absent."""
    c = table(spark, sf, "customer").select(
        F.lit("crm").alias("source_id"), F.expr("'c' || c_custkey").alias("native_id"), F.lit("session").alias("kind"), F.col("c_name").alias("label"),
        F.expr("if(c_custkey % 3 = 0, c_mktsegment, null)").alias("vendor_title"), (F.col("c_custkey") * 1000).alias("started_ms"),
        F.expr("if(c_custkey % 4 = 0, null, cast(c_acctbal * 100 AS bigint))").alias("activity_ms"), F.expr("'n' || if(c_custkey % 10 = 0, 99, c_nationkey)").alias("parent_native_id"), F.col("c_custkey").alias("seq"))
    n = table(spark, sf, "nation").select(
        F.lit("crm").alias("source_id"), F.expr("'n' || n_nationkey").alias("native_id"), F.lit("workspace").alias("kind"), F.col("n_name").alias("label"), F.lit(None).cast("string").alias("vendor_title"),
        F.lit(0).cast("bigint").alias("started_ms"), F.lit(None).cast("bigint").alias("activity_ms"), F.lit(None).cast("string").alias("parent_native_id"), F.col("n_nationkey").cast("bigint").alias("seq"))
    return c.unionByName(n)


ENT = """ent AS (SELECT 'c' || c_custkey AS native_id, 'session' AS kind, c_name AS label, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS vendor_title, c_custkey * 1000 AS started_ms,
    CASE WHEN c_custkey % 4 <> 0 THEN CAST(trunc(round(c_acctbal * 100, 4)) AS BIGINT) END AS activity_ms, 'n' || CASE WHEN c_custkey % 10 = 0 THEN 99 ELSE c_nationkey END AS parent FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'workspace', n_name, NULL, 0, NULL, NULL FROM nation)"""


def relations(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.lit("crm").alias("source_id"), F.expr("'c' || c_custkey").alias("from_id"), F.expr("if(c_custkey % 5 = 0, 'c' || (c_custkey + 1), 'n' || (c_custkey % 40))").alias("to_id"),
                    F.expr("if(c_custkey % 2 = 0, 'parent', 'uses')").alias("kind"))


REL = """rel AS (SELECT 'c' || c_custkey AS from_id, CASE WHEN c_custkey % 5 = 0 THEN 'c' || (c_custkey + 1) ELSE 'n' || (c_custkey % 40) END AS to_id, CASE WHEN c_custkey % 2 = 0 THEN 'parent' ELSE 'uses' END AS kind FROM customer)"""


@query("a20_source_totals", f"WITH {ENT} SELECT 'crm' AS source_id, count(*) AS entities, max(COALESCE(activity_ms, started_ms)) AS last_activity_ms FROM ent")
def a20(spark, sf):
    return C.source_totals(entities(spark, sf).withColumn("activity_ms", F.when(F.col("activity_ms").isNotNull(), F.col("activity_ms"))))


@query("c01_sessions", f"""WITH {AG}, u AS (SELECT session_id, min(ordinal) AS o FROM ag WHERE role = 'user' AND session_id IS NOT NULL GROUP BY 1) SELECT a.session_id AS native_id, min((1700000000 + conv_id * 60 + turn) * 1000) AS started_ms, max((1700000000 + conv_id * 60 + turn) * 1000) AS activity_ms,
  count(*) AS records, min(ordinal) AS first_ordinal, max(u.o) IS NOT NULL AS has_preview FROM ag a LEFT JOIN u USING (session_id) WHERE a.session_id IS NOT NULL GROUP BY 1""")
def c01(spark, sf):
    return C.sessions(agent_events(spark, sf)).select("native_id", "started_ms", "activity_ms", "records", "first_ordinal", F.col("preview").isNotNull().alias("has_preview"))


@query("c02_entity_kind", """SELECT p_partkey, list_extract(['session', 'thread', 'other', 'subagent', 'subagent', 'workflow', 'team', 'tool', 'tool', 'goal', 'plan', 'memory', 'task', 'event', 'event', 'event', 'session', 'other', 'subagent', 'other'],
  CAST(p_partkey % 20 AS INT) + 1) AS kind FROM part""")
def c02(spark, sf):
    """Expected kinds are written out by hand, mixed names and unknown ones among them."""
    names = ["ChatSession", "chat_thread", "fork", "MySubAgent", "AgentRun", "workflow", "Team", "ToolUse", "function_call", "goal", "PLAN", "memory", "task", "event", "message", "response",
             "agent session", "fork of an agent", "team agent", "workspace"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 20 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", C.entity_kind(name).alias("kind"))


@query("c03_first_wins", "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1")
def c03(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return C.first_wins(li, ["l_partkey"]).distinct()


@query("c04_append_snapshot", f"WITH {ENT} SELECT native_id, CASE WHEN native_id IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 3 = 1) THEN label || ' v2' ELSE label END AS label FROM ent")
def c04(spark, sf):
    e = entities(spark, sf).select("source_id", "native_id", "label", "seq", "kind")
    page = e.filter("kind = 'session' AND seq % 3 = 1").withColumn("label", F.concat("label", F.lit(" v2")))
    return C.append_snapshot(e, page, C.ENTITY).select("native_id", "label")


@query("c04_union_relations", f"WITH {REL} SELECT DISTINCT from_id, to_id, kind FROM rel")
def c04b(spark, sf):
    r = relations(spark, sf)
    return C.union_relations(r, r.filter("kind = 'uses'")).select("from_id", "to_id", "kind")


@query("c05_replace_snapshot", "SELECT n_regionkey AS region, count(*) FILTER (n_regionkey <> 1) + count(*) FILTER (n_regionkey = 1 AND n_nationkey % 2 = 0) AS rows FROM nation GROUP BY 1")
def c05(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("source_id"), "n_nationkey")
    return C.replace_snapshot(n, n.filter("source_id = 1 AND n_nationkey % 2 = 0")).groupBy(F.col("source_id").alias("region")).agg(F.count(F.lit(1)).alias("rows"))


@query("c06_guarded_write", "SELECT 's' || s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 1 THEN 'fingerprint-changed' ELSE 'generation-changed' END AS reason FROM supplier WHERE s_suppkey % 3 <> 0")
def c06(spark, sf):
    s = table(spark, sf, "supplier").select(F.expr("'s' || s_suppkey").alias("source_id"), "s_suppkey", F.lit(1).alias("generation"), F.col("s_name").alias("fingerprint"))
    expected = s.select("source_id", F.expr("if(s_suppkey % 3 = 2, 0, 1)").alias("generation"), F.expr("if(s_suppkey % 3 = 1, 'old', fingerprint)").alias("fingerprint"))
    return C.guarded(s, expected)


@query("c07_fingerprints", "SELECT l_suppkey AS source, count(*) AS files, true AS same FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem) GROUP BY 1")
def c07(spark, sf):
    f = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").distinct()
    f = f.select(F.col("l_suppkey").alias("source_id"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("path"), F.col("l_partkey").alias("size_bytes"), F.col("l_orderkey").alias("mtime"))
    a, b = C.fingerprints(f), C.fingerprints(f.repartition(7, "path")).select("source_id", F.col("fingerprint").alias("again"))
    return a.join(b, "source_id").select(F.col("source_id").alias("source"), "files", (F.col("fingerprint") == F.col("again")).alias("same"))


@query("c08_source_id", "SELECT page_id, 'web-' || substr(sha256(lower(rtrim(url, '/'))), 1, 16) AS source_id FROM pages")
def c08(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.source_id(F.lit("web"), F.concat("url", F.when(F.col("page_id") % 2 == 0, "/").otherwise(""))).alias("source_id"))


def commands(spark, sf):
    """A command log from the order lines: orders are requests, suppliers collections, parts entries; requests repeat."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_suppkey", "l_partkey", "l_quantity"), F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    rev = F.expr("l_orderkey * 10 + l_linenumber")
    op = F.expr("element_at(array('create', 'rename', 'add', 'add', 'remove', 'alias', 'archive', 'restore', 'delete'), cast(l_quantity AS int) % 9 + 1)")
    log = li.select(rev.alias("revision"), F.expr("'q' || (l_orderkey * 4 + l_linenumber div 2)").alias("request_id"), op.alias("op"), F.expr("'k' || (l_suppkey % 50)").alias("collection_id"),
                    F.expr("'e' || (l_partkey % 200)").alias("entry_id"), F.expr("'t' || l_partkey").alias("text"))
    on_entry = F.col("op").isin("add", "remove", "alias", "archive", "restore")
    return log.withColumn("entry_id", F.when(on_entry, F.col("entry_id")))


LOG = """li AS (SELECT l_orderkey, l_linenumber, unnest(min_by({'s': l_suppkey, 'p': l_partkey, 'q': l_quantity}, (l_partkey, l_suppkey, l_quantity, l_extendedprice))) FROM lineitem GROUP BY 1, 2),
  lg AS (SELECT l_orderkey * 10 + l_linenumber AS revision, 'q' || (l_orderkey * 4 + l_linenumber // 2) AS request_id, list_extract(['create', 'rename', 'add', 'add', 'remove', 'alias', 'archive', 'restore', 'delete'], CAST(q AS INT) % 9 + 1) AS op,
    'k' || (s % 50) AS cid, 'e' || (p % 200) AS eid, 't' || p AS text FROM li),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY revision) AS rn FROM lg) WHERE rn = 1),
  del AS (SELECT cid, max(revision) AS d FROM once WHERE op = 'delete' GROUP BY 1),
  cre AS (SELECT o.cid, min(o.revision) AS c FROM once o LEFT JOIN del USING (cid) WHERE o.op = 'create' AND (d IS NULL OR o.revision > d) GROUP BY 1),
  live AS (SELECT o.cid, arg_max(o.text, o.revision) AS name FROM once o JOIN cre USING (cid) WHERE (o.op = 'create' AND o.revision = c) OR (o.op = 'rename' AND o.revision > c) GROUP BY 1),
  mem AS (SELECT cid, eid FROM (SELECT o.cid, o.eid, arg_max(o.op, o.revision) AS op FROM once o JOIN cre USING (cid) WHERE o.op IN ('add', 'remove') AND o.revision > c GROUP BY 1, 2) WHERE op = 'add')"""


@query("c09_collections", f"WITH {LOG} SELECT cid AS collection_id, name, (SELECT count(*) FROM mem WHERE mem.cid = live.cid) AS entries FROM live")
def c09(spark, sf):
    return C.collection_counts(C.fold_commands(commands(spark, sf)))


@query("a21_collection_counts", f"WITH {LOG} SELECT entries, count(*) AS collections FROM (SELECT (SELECT count(*) FROM mem WHERE mem.cid = live.cid) AS entries FROM live) GROUP BY 1")
def a21(spark, sf):
    return C.collection_counts(C.fold_commands(commands(spark, sf))).groupBy("entries").agg(F.count(F.lit(1)).alias("collections"))


@query("r20_archived_members", f"WITH {LOG} SELECT DISTINCT eid AS entry_id FROM mem WHERE eid IN (SELECT eid FROM once WHERE op IN ('archive', 'restore') GROUP BY 1 HAVING arg_max(op, revision) = 'archive')")
def r20(spark, sf):
    return C.archived_members(C.fold_commands(commands(spark, sf)))


@query("c10_union_sources", "SELECT 'supplier' AS origin, count(*) AS n FROM supplier UNION ALL SELECT 'customer', count(*) FROM customer")
def c10(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(t).alias("origin"), F.concat(F.lit(f"{t}:"), F.col(k).cast("string")).alias("key"), *extra) for t, k, extra in
             (("supplier", "s_suppkey", ["s_acctbal"]), ("customer", "c_custkey", []))]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.groupBy("origin").agg(F.count_distinct("key").alias("n"))


@query("c11_expire", "SELECT n_regionkey AS source_id, count(*) AS n FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3) GROUP BY 1")
def c11(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_regionkey", "source_id")
    return C.expire(n, table(spark, sf, "region").filter("r_regionkey < 3").withColumnRenamed("r_regionkey", "source_id")).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("c12_search", f"WITH {ENT}, {REL}, p AS (SELECT native_id FROM ent WHERE kind = 'session' AND contains(lower(label), 'customer#00000001') ORDER BY native_id LIMIT 5 OFFSET 1) SELECT DISTINCT from_id, to_id, kind FROM rel WHERE from_id IN (SELECT * FROM p) OR to_id IN (SELECT * FROM p)")
def c12(spark, sf):
    return C.search(entities(spark, sf), relations(spark, sf), kind="session", text="CUSTOMER#00000001", offset=1, limit=5)[1].select("from_id", "to_id", "kind")


@query("c13_thread_entities", """SELECT o_orderkey AS thread_id, COALESCE(CASE WHEN o_orderkey % 4 = 0 THEN 'name' END, CASE WHEN o_custkey % 2 = 0 THEN 'index' END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, o_orderpriority) AS title,
  CASE WHEN o_orderkey % 7 = 0 AND o_orderkey > 0 THEN o_orderkey - 1 END AS parent_id, CASE WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'active' END AS status FROM orders""")
def c13(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "thread_id")
    threads = o.select("thread_id", F.expr("if(thread_id % 4 = 0, 'name', null)").alias("name"), F.expr("if(thread_id % 3 = 0, o_orderstatus, null)").alias("agent"), F.col("o_orderpriority").alias("row_title"), (F.col("o_orderstatus") == "F").alias("archived"))
    titles = o.filter("o_custkey % 2 = 0").select("thread_id", F.lit("index").alias("index_title"))
    spawns = o.filter("thread_id % 7 = 0 AND thread_id > 0").select((F.col("thread_id") - 1).alias("parent_id"), F.col("thread_id").alias("child_id"))
    return C.thread_entities(threads, titles, spawns).select("thread_id", "title", "parent_id", "status")


@query("c14_locations", "SELECT DISTINCT 'c' || o_custkey AS native_id, o_orderkey AS ordinal FROM orders JOIN customer ON o_custkey = c_custkey")
def c14(spark, sf):
    o = table(spark, sf, "orders")
    loc = o.select(F.lit("crm").alias("source_id"), F.expr("'c' || o_custkey").alias("native_id"), F.col("o_orderkey").alias("ordinal"))
    rec = o.select(F.lit("crm").alias("source_id"), F.col("o_orderkey").alias("ordinal"), F.lit("g1").alias("generation"))
    return C.locate(entities(spark, sf).select("source_id", "native_id"), loc, rec).select("native_id", "ordinal")


@query("c15_stale_sources", "SELECT 's' || s_suppkey AS source_id FROM supplier WHERE s_suppkey % 5 IN (0, 1, 2)")
def c15(spark, sf):
    s = table(spark, sf, "supplier").select(F.expr("'s' || s_suppkey").alias("source_id"), "s_suppkey", F.col("s_name").alias("fingerprint"))
    probed = s.filter("s_suppkey % 5 != 1").withColumn("fingerprint", F.expr("if(s_suppkey % 5 = 0, 'x', fingerprint)"))
    return C.stale_sources(s.filter("s_suppkey % 5 != 2"), probed)


@query("c16_title_overrides", f"WITH {ENT} SELECT native_id, CASE WHEN kind = 'session' AND started_ms // 1000 % 6 = 0 THEN 'mine' WHEN kind = 'session' AND started_ms // 1000 % 6 = 2 THEN 'old' ELSE COALESCE(vendor_title, label) END AS title FROM ent")
def c16(spark, sf):
    e = entities(spark, sf)
    base = e.filter("kind = 'session' AND seq % 2 = 0").select(*C.ENTITY, F.lit("old").alias("title"), "seq")
    changes = base.filter("seq % 6 != 2").select(*C.ENTITY, F.expr("if(seq % 6 = 0, 'mine', null)").alias("title"))
    return C.titled(e, C.override_titles(base.drop("seq"), changes)).select("native_id", "title")


@query("r16_reconcile_parents", f"WITH {ENT}, {REL}, g AS (SELECT from_id, to_id FROM rel WHERE kind = 'parent' AND to_id IN (SELECT native_id FROM ent)) SELECT native_id, COALESCE(to_id, parent) AS parent_native_id, CASE WHEN to_id IS NULL THEN 'root' ELSE 'subagent' END AS relationship FROM ent LEFT JOIN g ON from_id = native_id")
def r16(spark, sf):
    return C.reconcile_parents(entities(spark, sf), relations(spark, sf)).select("native_id", "parent_native_id", "relationship")


@query("r17_orphans", f"WITH {ENT} SELECT native_id FROM ent WHERE parent IS NOT NULL AND parent NOT IN (SELECT native_id FROM ent)")
def r17(spark, sf):
    return C.orphans(entities(spark, sf)).select("native_id")


@query("r18_fork_edges", "SELECT 'o' || o_orderkey AS from_id, 'o' || (o_orderkey - 3) AS to_id, 'fork' AS kind FROM orders WHERE o_orderkey % 5 = 4 AND o_orderkey >= 3")
def r18(spark, sf):
    o = table(spark, sf, "orders")
    forks = o.select(F.expr("'/H/s//' || o_orderkey || '.jsonl'").alias("path"), F.expr("'o' || o_orderkey").alias("native_id"),
                     F.expr("if(o_orderkey % 5 = 4, '\\\\h\\\\s\\\\' || (o_orderkey - 3) || '.JSONL', null)").alias("parent_path"))
    return C.fork_edges(forks)


@query("r19_titles", f"WITH {ENT} SELECT native_id, COALESCE(vendor_title, label) AS title FROM ent")
def r19(spark, sf):
    e = entities(spark, sf)
    return C.titled(e, e.filter("false").select(*C.ENTITY, F.col("label").alias("title"))).select("native_id", "title")


@query("r21_relation_inputs", f"""WITH {ENT} SELECT DISTINCT 'c' || c_custkey AS from_id, 'n' || (c_custkey % 30) AS to_id, 'uses' AS kind FROM customer WHERE c_custkey % 30 < 25 UNION SELECT 'c' || (c_custkey + 1), 'c' || c_custkey, 'parent' FROM customer WHERE 'c' || (c_custkey + 1) IN (SELECT native_id FROM ent)""")
def r21(spark, sf):
    c = table(spark, sf, "customer")
    links = F.expr("array(named_struct('kind', 'uses', 'id', 'n' || (c_custkey % 30)), named_struct('kind', 'child', 'id', 'c' || (c_custkey + 1)), named_struct('kind', 'odd', 'id', 'n1'))")
    rows = c.select(F.lit("crm").alias("source_id"), F.expr("'c' || c_custkey").alias("native_id"), links.alias("links"))
    return C.relation_inputs(rows, entities(spark, sf)).select("from_id", "to_id", "kind")


@query("r22_checked_rows", """SELECT c_custkey, list_extract([NULL, 'missing_id', 'unsupported_type', 'missing_id', 'invalid_id', 'invalid_label', 'invalid_label', 'invalid_parent', 'invalid_timestamp', 'invalid_status', 'invalid_confidence', NULL],
  CAST(c_custkey % 12 AS INT) + 1) AS reject FROM customer""")
def r22(spark, sf):
    """One fault in each row, in a turn of twelve; expected codes are written out by hand."""
    k = F.col("c_custkey") % 12
    def pick(fault: int, wrong, right) -> F.Column:
        return F.when(k == fault, F.lit(wrong)).otherwise(right)
    rows = table(spark, sf, "customer").select(
        "c_custkey", pick(1, None, pick(2, "spaceship", F.lit("session"))).alias("type"), pick(3, "", pick(4, "a b", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))).alias("id"),
        pick(5, "C:\\x", pick(6, "a\nb", pick(11, None, F.col("c_name")))).alias("label"), pick(7, "no/slash", F.lit(None).cast("string")).alias("parent_id"), pick(8, "", F.lit("2025-01-01")).alias("updated_at"),
        pick(9, "s" * 129, F.lit("open")).alias("status"), pick(10, "sure", F.lit("inferred")).alias("confidence"))
    return C.checked_rows(rows).select("c_custkey", "reject")


@query("w04_children_page", f"WITH {ENT} SELECT native_id, label, false AS has_more FROM (SELECT *, row_number() OVER (ORDER BY COALESCE(activity_ms, started_ms) DESC, native_id) AS n FROM ent WHERE parent = 'n3') WHERE n > 7 AND n <= 100000")
def w04(spark, sf):
    """All after the first page of seven; a quarter of the children have no activity and fall back to their start."""
    e, mine = entities(spark, sf), F.col("parent_native_id") == "n3"
    last = C.children_page(e, mine, "activity", 7).orderBy("sort_value", F.col("native_id").desc()).first()
    return C.children_page(e, mine, "activity", 100_000, (last["sort_value"], last["native_id"])).select("native_id", "label", "has_more")


@query("w05_has_children", f"WITH {ENT} SELECT native_id FROM ent WHERE native_id IN (SELECT parent FROM ent)")
def w05(spark, sf):
    return C.with_children(entities(spark, sf)).select("native_id")


@query("j16_user_preview", "SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN substr(trim(regexp_replace(CASE WHEN turn % 3 = 1 THEN 'Caveat: ' ELSE '' END || text, '\\s+', ' ', 'g')), 1, 240) END AS preview FROM conversations")
def j16(spark, sf):
    t = F.expr("CASE turn % 3 WHEN 0 THEN '\\n <permissions instructions> ' || text WHEN 1 THEN 'Caveat: ' || text ELSE text END")
    return table(spark, sf, "conversations").select("conv_id", "turn", C.user_preview(t).alias("preview"))


@query("j28_normalize_id", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '_page-' || repeat('0', 200) || page_id ELSE 'id-' || substr(sha256(url), 1, 32) END AS id FROM pages")
def j28(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.normalize_id(F.expr("if(page_id % 2 = 0, '_page-' || repeat('0', 200) || page_id, url)")).alias("id"))
