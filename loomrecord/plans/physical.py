"""Queries over physical lines: tables are staged as JSON Lines files, then scanned, exported or followed."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.operators import page as P
from loomrecord.operators import records as R
from loomrecord.operators import where as W
from loomrecord.plans.corpora import app_logs
from loomrecord.plans.registry import query, table
from loomrecord.plans.relations import AG, PARENTS, agent_events, agent_records
from loomrecord.session import materialize, scratch_dir
from loomrecord.sources import scan as S
from loomrecord.streaming import incremental as X
from loomrecord.streaming import progress as G


def staged(spark, sf) -> str:
    """Documents as lines: CRLF and LF, blank, malformed, not UTF-8, and plain."""
    line = F.expr("""CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN '{"doc":' || doc_id WHEN 2 THEN string(unhex('7B22FF')) WHEN 3 THEN to_json(struct(doc_id AS doc, lang)) || '\\r'
      WHEN 4 THEN '{"doc":' || doc_id || '} x' ELSE to_json(struct(doc_id AS doc, lang, text)) END""")
    target = f"{scratch_dir(spark)}/lines"
    df = table(spark, sf, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    df.select(line.alias("value")).write.text(target)
    return target


def scanned(spark, sf):
    # Well below the default, so that lines cross split borders at the smaller scales.
    return S.scan_records(spark, staged(spark, sf), 1 << 20)


STATE = "CASE doc_id % 10 WHEN 0 THEN 'blank' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'encoding_error' WHEN 4 THEN 'invalid_json' ELSE 'valid' END"


@query("s01_scan_records", f"SELECT {STATE} AS parse_state, CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END AS delim_len, count(*) AS records FROM documents GROUP BY 1, 2")
def s01(spark, sf):
    return scanned(spark, sf).groupBy("parse_state", "delim_len").agg(F.count(F.lit(1)).alias("records"))


@query("s02_ordinals", "SELECT doc_id AS doc, 0 AS drift FROM documents WHERE doc_id % 10 IN (3, 5, 6, 7, 8, 9)")
def s02(spark, sf):
    rows = scanned(spark, sf).filter("parse_state = 'valid'").select("source_id", "ordinal", J.number_at(F.col("value"), "doc").cast("bigint").alias("doc"))
    base = rows.groupBy("source_id").agg(F.min(F.col("doc") - F.col("ordinal")).alias("base"))
    return rows.join(F.broadcast(base), "source_id").select("doc", (F.col("doc") - F.col("ordinal") - F.col("base")).alias("drift"))


@query("s03_parse_states", f"SELECT {STATE} AS parse_state, count(*) AS n FROM documents GROUP BY 1")
def s03(spark, sf):
    return scanned(spark, sf).groupBy("parse_state").agg(F.count(F.lit(1)).alias("n"))


@query("s04_problems", """SELECT code, severity, count(*) AS n FROM (SELECT CASE doc_id % 10 WHEN 0 THEN 'BLANK_RECORD' WHEN 2 THEN 'INVALID_UTF8' ELSE 'INVALID_JSON' END AS code,
  CASE doc_id % 10 WHEN 0 THEN 'warning' ELSE 'error' END AS severity FROM documents WHERE doc_id % 10 IN (0, 1, 2, 4)) GROUP BY 1, 2""")
def s04(spark, sf):
    return R.problems(scanned(spark, sf)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("s05_document_summary", "SELECT count(*) AS records, count(*) FILTER (doc_id % 10 IN (3, 5, 6, 7, 8, 9)) AS valid, count(*) FILTER (doc_id % 10 = 0) AS blank, count(*) FILTER (doc_id % 10 IN (0, 1, 2, 4)) AS problems FROM documents")
def s05(spark, sf):
    s = R.document_summary(scanned(spark, sf))
    return s.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("records", "valid", "blank", "problems")])


@query("s06_get_record", "SELECT doc_id AS doc FROM documents WHERE lang = 'de' AND doc_id % 10 IN (3, 5, 6, 7, 8, 9)")
def s06(spark, sf):
    recs = scanned(spark, sf)
    refs = W.where(recs, {"op": "eq", "path": ["lang"], "value": "de"}).select(*R.COORDINATES)
    return R.get_records(recs, refs).select(J.number_at(F.col("value"), "doc").cast("bigint").alias("doc"))


@query("s06_stale_refs", "SELECT count(*) AS stale FROM documents WHERE lang = 'de' AND doc_id % 10 IN (3, 5, 6, 7, 8, 9)")
def s06b(spark, sf):
    recs = scanned(spark, sf)
    refs = W.where(recs, {"op": "eq", "path": ["lang"], "value": "de"}).select(*R.COORDINATES).withColumn("generation", F.lit("older"))
    return R.stale_refs(recs, refs).agg(F.count(F.lit(1)).alias("stale"))


@query("s07_record_text", "SELECT doc_id AS doc, octet_length(encode(text)) <= 500 AS complete, CASE WHEN octet_length(encode(text)) <= 500 THEN text ELSE '' END AS text FROM documents")
def s07(spark, sf):
    body = F.col("text").cast("binary")
    t = R.record_text(body, F.octet_length(body), 500)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), t["complete"].alias("complete"), t["text"].alias("text"))


@query("s08_raw_page", """WITH p AS (SELECT doc_id AS ordinal, sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS c FROM documents WHERE doc_id >= 20)
  SELECT ordinal, (SELECT min(ordinal) FROM p WHERE c > 60000) AS next_ordinal, 'max-bytes' AS reason FROM p WHERE c <= 60000""")
def s08(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), F.octet_length("text").cast("bigint").alias("content_len"))
    return P.raw_page(d, 20, 10_000, 60_000).select("ordinal", "next_ordinal", "reason")


@query("s09_source_surface", """SELECT page_id, list_extract(['codex-rollout', 'codex-rollout', NULL, 'codex-rollout', 'codex-rollout', NULL, NULL, 'codex-history', 'claude-job-timeline', NULL, 'codex-trace', 'codex-compressed-rollout', 'codex-tui-session-log', 'codex-tui-session-log', 'codex-session-index', NULL], i) AS kind,
  list_extract(['strong', 'strong', NULL, 'weak', 'weak', NULL, NULL, 'strong', 'strong', NULL, 'weak', 'weak', 'strong', 'weak', 'weak', NULL], i) AS strength FROM (SELECT page_id, CAST(page_id % 16 AS INT) + 1 AS i FROM pages)""")
def s09(spark, sf):
    """Expected kinds and strengths are written out by hand."""
    paths = ["/h/sessions/2025/01/31/rollout-x.jsonl", "C:\\h\\archived_sessions\\Rollout-x.jsonl", "/x/history.jsonl", "/copy/Rollout-x.jsonl", "/x/sessions/a.jsonl", "/h/.claude/projects/p/x.jsonl", "/h/.claude/history.jsonl",
             "/h/.codex/history.jsonl", ".claude/jobs/j/timeline.jsonl", "/x/timeline.jsonl", "/x/trace.jsonl", "/h/sessions/rollout-x.jsonl.zst", "/h/.codex/log/session-20250131T010203Z.jsonl", "/x/session-7.jsonl", "/x/session_index.jsonl", "/x/y.jsonl"]
    path = F.element_at(F.array(*[F.lit(p) for p in paths]), (F.col("page_id") % 16 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", S.source_surface(path).alias("s")).select("page_id", "s.kind", "s.strength")


@query("s13_detection_sample", """WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id AS ordinal FROM events, n WHERE event_id < 32 OR event_id >= n - 32 OR event_id BETWEEN n // 4 AND n // 4 + 7
  OR event_id BETWEEN n // 2 AND n // 2 + 7 OR event_id BETWEEN n * 3 // 4 AND n * 3 // 4 + 7""")
def s13(spark, sf):
    return S.detection_sample(app_logs(spark, sf)).select("ordinal")


@query("k01_raw_export", f"SELECT {STATE} AS parse_state, CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END AS delim_len, count(*) AS records, 0 AS byte_drift FROM documents GROUP BY 1, 2")
def k01(spark, sf):
    source = scanned(spark, sf)
    target = f"{scratch_dir(spark)}/export"
    S.export_raw(source, target)
    def tally(df, name):
        return df.groupBy("parse_state", "delim_len").agg(F.count(F.lit(1)).alias(f"{name}records"), F.sum("content_len").alias(f"{name}bytes"))
    out = tally(source, "in_").join(tally(S.scan_records(spark, target, 1 << 20), ""), ["parse_state", "delim_len"])
    return out.select("parse_state", "delim_len", "records", (F.col("bytes") - F.col("in_bytes")).alias("byte_drift"))


@query("k02_scoped_export", "SELECT doc_id AS doc, lang FROM documents WHERE lang = 'fr' AND doc_id % 10 IN (3, 5, 6, 7, 8, 9)")
def k02(spark, sf):
    target = f"{scratch_dir(spark)}/export"
    match = F.col("value").isNotNull() & W.condition({"op": "eq", "path": ["lang"], "value": "fr"})
    S.export_raw(scanned(spark, sf), target, match, partitions=4)
    back = S.scan_records(spark, target)
    return back.select(J.number_at(F.col("value"), "doc").cast("bigint").alias("doc"), J.string_at(F.col("value"), "lang").alias("lang"))


@query("k03_export_receipt", "SELECT count(*) FILTER (lang = 'fr' AND doc_id % 10 IN (3, 5, 6, 7, 8, 9)) AS records, count(*) AS examined_records FROM documents")
def k03(spark, sf):
    match = F.col("value").isNotNull() & W.condition({"op": "eq", "path": ["lang"], "value": "fr"})
    return S.export_receipt(scanned(spark, sf), match).select("records", "examined_records")


@query("k04_selection_digest", "SELECT count(*) AS refs, count(*) FILTER (event_id % 100 = 0) AS conflicts, true AS order_free FROM events")
def k04(spark, sf):
    ev = table(spark, sf, "events").select(F.lit("e").alias("source_id"), F.col("event_id").alias("ordinal"), (F.col("event_id") * 10).alias("byte_start"), (F.col("event_id") * 10 + 9).alias("byte_end"))
    clash = ev.filter("ordinal % 100 = 0").withColumn("byte_end", F.col("byte_end") + 1)
    a = S.selection_digest(ev.unionByName(clash).unionByName(ev))
    b = S.selection_digest(clash.unionByName(ev.orderBy(F.col("ordinal").desc()))).select(F.col("digest").alias("again"))
    return a.join(F.broadcast(b)).select("refs", "conflicts", (F.col("digest") == F.col("again")).alias("order_free"))


@query("k05_typed_output", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def k05(spark, sf):
    typed = app_logs(spark, sf).select("source_id", "ordinal", "text", F.get_json_object("text", "$.type").alias("kind"))
    return materialize(typed, "events", ["source_id"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("x02_refresh", """SELECT 'unchanged' AS change, count(*) AS n FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT 'append', count(*) FROM customer WHERE c_custkey % 6 = 1 UNION ALL SELECT 'truncate', count(*) FROM customer WHERE c_custkey % 6 = 2
  UNION ALL SELECT 'replace', count(*) FROM customer WHERE c_custkey % 6 = 3 UNION ALL SELECT 'delete', count(*) FROM customer WHERE c_custkey % 6 = 4 UNION ALL SELECT 'new', count(*) FROM customer WHERE c_custkey % 6 = 5""")
def x02(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey") % 6)
    old = c.filter("k != 5").select(F.col("c_name").alias("source_id"), F.lit(100).alias("size_bytes"), F.lit(1).alias("mtime"), F.sha2("c_name", 256).alias("prefix_sha"))
    new = c.filter("k != 4").select(F.col("c_name").alias("source_id"), F.expr("CASE k WHEN 1 THEN 150 WHEN 2 THEN 50 ELSE 100 END").alias("size_bytes"), F.lit(2).alias("mtime"),
                                    F.sha2(F.expr("if(k = 3, c_name || '!', c_name)"), 256).alias("prefix_sha"))
    return S.refresh(old, new).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def drain(spark, stream, sink: str, mode: str = "append"):
    """Run a stream over what is there, writing each batch to a folder with its number."""
    folder = scratch_dir(spark)

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/{sink}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/{sink}")


@query("x01_follow_lines", "SELECT count(*) AS lines, count(DISTINCT doc_id) AS docs FROM documents WHERE doc_id % 10 IN (3, 5, 6, 7, 8, 9)")
def x01(spark, sf):
    stream = S.follow_records(spark, staged(spark, sf))
    recs = R.parse_texts(stream.filter(F.is_valid_utf8(F.col("raw").cast("string"))).select(F.col("raw").cast("string").alias("text")))
    got = drain(spark, recs.filter("parse_state = 'valid'").select(J.number_at(F.col("value"), "doc").cast("bigint").alias("doc")), "lines")
    return got.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("doc").alias("docs"))


@query("x07_progress", """SELECT count(*) AS records, count(*) FILTER (doc_id % 10 IN (3, 5, 6, 7, 8, 9)) AS valid, count(*) FILTER (doc_id % 10 = 0) AS blank,
  sum(CASE doc_id % 10 WHEN 1 THEN length('{"doc":' || doc_id) WHEN 2 THEN 3 WHEN 4 THEN length('{"doc":' || doc_id || '} x') ELSE 0 END)::BIGINT AS problem_bytes FROM documents""")
def x07(spark, sf):
    stream = R.classify(S.follow_records(spark, staged(spark, sf)), raw="raw")
    q = G.observed_stream(stream).writeStream.format("noop").option("checkpointLocation", f"{scratch_dir(spark)}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return G.progress(spark, q).agg(*[F.max(f"total_{m}").alias(m) for m in ("records", "valid", "blank", "problem_bytes")])


@query("x04_incremental_relations", f"""WITH {AG}, {PARENTS}, e AS (SELECT CASE WHEN COALESCE(pm, ps) IS NOT NULL THEN 'parent_child' WHEN lm IS NULL OR ls < lm OR child_kind = 'subagent' THEN 'subagent_parent' ELSE 'parent_child' END AS kind,
    COALESCE(pm, ps, least(lm, ls)) AS s FROM p UNION ALL SELECT 'tool_pair', a.ordinal FROM ag a JOIN ag b ON a.tool_call_id = b.tool_call_id WHERE a.event_kind = 'tool_call' AND b.event_kind = 'tool_result'
    UNION ALL SELECT 'session_member', f FROM (SELECT ordinal, min(ordinal) OVER (PARTITION BY session_id) AS f FROM ag WHERE session_id IS NOT NULL) WHERE f <> ordinal
    UNION ALL SELECT 'turn_member', f FROM (SELECT ordinal, min(ordinal) OVER (PARTITION BY turn_id) AS f FROM ag) WHERE f <> ordinal)
  SELECT kind, count(*) AS edges, CAST(sum(s) AS BIGINT) AS source_sum FROM e WHERE s IS NOT NULL GROUP BY 1""")
def x04(spark, sf):
    """Two deliveries in record order, early turns of every conversation and then the later ones; the early ones come again with them."""
    base = scratch_dir(spark)
    columns = ["source_id", "profile_id", "ordinal", "event_kind", "session_id", "turn_id", "message_id", "parent_id", "tool_call_id", "subagent_id"]
    events = materialize(agent_events(spark, sf).select(*columns), "events")
    early = F.col("ordinal") % 10 < 3
    for n, part in enumerate((events.filter(early), events)):
        part.write.parquet(f"{base}/in/delivery{n}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        X.stream_relations(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(X.EDGES).parquet(f"{base}/out").groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.sum("source_key").cast("bigint").alias("source_sum"))


@query("x05_stream_buckets", "SELECT floor((epoch_us(ts) // 1000) / 3600000)::BIGINT * 3600000 AS start_ms, event_type AS label, count(*) AS \"count\" FROM events GROUP BY 1, 2")
def x05(spark, sf):
    base = f"{scratch_dir(spark)}/in"
    ev = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    ev.write.parquet(base)
    out = X.stream_categories(spark.readStream.schema(ev.schema).parquet(base), "event_type", "1 hour", "31 days")
    got = drain(spark, out, "counts", "update")
    return got.groupBy("start_ms", "label").agg(F.max_by("count", "batch").alias("count"))


@query("x06_stream_problems", "SELECT CASE doc_id % 10 WHEN 0 THEN 'BLANK_RECORD' WHEN 2 THEN 'INVALID_UTF8' ELSE 'INVALID_JSON' END AS code, count(*) AS n FROM documents WHERE doc_id % 10 IN (0, 1, 2, 4) GROUP BY 1")
def x06(spark, sf):
    stream = R.classify(S.follow_records(spark, staged(spark, sf)), raw="raw")
    return drain(spark, X.stream_problems(stream), "problems").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("s11_head_tail", """WITH r AS (SELECT doc_id AS ordinal, sum(octet_length(encode(text)) + 1) OVER (ORDER BY doc_id) AS stop, octet_length(encode(text)) + 1 AS len FROM documents), z AS (SELECT max(stop) AS size FROM r)
  SELECT ordinal, CASE WHEN stop <= 98304 THEN 'head' ELSE 'tail' END AS part FROM r, z WHERE stop <= 98304 OR stop - len >= size - 65536""")
def s11(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("d").alias("source_id"), F.col("doc_id").alias("ordinal"), (F.octet_length("text") + 1).cast("bigint").alias("len"))
    run = P.running_bytes(d, "len", 256)
    recs = run.select("source_id", "ordinal", (F.col("cumulative") - F.col("len")).alias("byte_start"), (F.col("cumulative") - 1).alias("byte_end"), F.lit(1).alias("delim_len"))
    return S.head_tail(recs).select("ordinal", "part")
