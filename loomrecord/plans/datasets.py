"""Queries over training-data records derived from documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrecord.operators import dataset as D
from loomrecord.operators import parts as R
from loomrecord.operators.records import parse_texts
from loomrecord.plans.registry import query, table
from loomrecord.session import spread


def data_records(spark, sf):
    """One training record per document; the shape rotates with the id."""
    d = spread(table(spark, sf, "documents"))
    text = """CASE doc_id % 9
      WHEN 0 THEN to_json(struct(text, lang AS language))
      WHEN 1 THEN to_json(named_struct('messages', array(named_struct('role', 'user', 'content', lang, 'loss_weight', 0), named_struct('role', 'gpt', 'content', text, 'loss_weight', doc_id % 3)), 'split', source))
      WHEN 2 THEN to_json(named_struct('instruction', lang, 'output', if(doc_id % 2 = 0, text, '')))
      WHEN 3 THEN to_json(named_struct('question', lang, 'category', source))
      WHEN 4 THEN to_json(named_struct('chosen', text, 'rejected', if(doc_id % 4 = 0, null, lang)))
      WHEN 5 THEN to_json(named_struct('text', text, 'label', doc_id % 7, 'language', lang))
      WHEN 6 THEN to_json(named_struct('input_ids', array(1, -100, n_chars), 'labels', sequence(1, 2 + doc_id % 2), 'token_count', 3 + doc_id % 4))
      WHEN 7 THEN '[' || doc_id || ']'
      ELSE '{"conversations":[{"from":"human","value":[{"type":"image"},{"type":"text","text":"x"}]},{"from":"narrator","value":' || to_json(struct(text)) || '},7],"images":["a","b"]}' END"""
    return parse_texts(d.select(F.lit("data").alias("source_id"), F.col("doc_id").alias("ordinal"), F.expr(text).alias("text")))


DS = """ds AS (SELECT doc_id AS ordinal, doc_id % 9 AS m, doc_id, lang, source, n_chars,
  CASE doc_id % 9 WHEN 0 THEN 'pretraining' WHEN 1 THEN 'conversation' WHEN 2 THEN 'instruction' WHEN 3 THEN 'qa' WHEN 4 THEN 'preference' WHEN 5 THEN 'classification' WHEN 6 THEN 'tokenized' WHEN 7 THEN 'unknown' ELSE 'conversation' END AS scene,
  CASE doc_id % 9 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'present' WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'present' ELSE 'empty' END WHEN 3 THEN 'missing' WHEN 4 THEN CASE WHEN doc_id % 4 = 0 THEN 'missing' ELSE 'present' END
    WHEN 5 THEN 'present' WHEN 6 THEN 'not-applicable' WHEN 7 THEN 'unknown' ELSE 'missing' END AS target,
  CASE doc_id % 9 WHEN 2 THEN CASE WHEN doc_id % 2 = 1 THEN 'empty-target' ELSE '' END WHEN 3 THEN 'missing-target' WHEN 4 THEN CASE WHEN doc_id % 4 = 0 THEN 'missing-target,incomplete-preference' ELSE '' END
    WHEN 6 THEN concat_ws(',', CASE WHEN doc_id % 4 <> 0 THEN 'token-count-mismatch' END, CASE WHEN doc_id % 2 = 0 THEN 'token-length-mismatch' ELSE NULL END)
    WHEN 7 THEN 'invalid-record' WHEN 8 THEN 'missing-target,invalid-message,unknown-role' ELSE '' END AS issues FROM documents)"""


@query("a09_dataset_record_summary", f"""WITH {DS} SELECT ordinal, m <> 7 AS valid, scene, target, issues, CASE m WHEN 1 THEN 2 WHEN 8 THEN 3 ELSE 0 END AS messages, CASE WHEN m IN (1, 8) THEN 1 ELSE 0 END AS role_user,
  CASE WHEN m = 1 THEN 1 ELSE 0 END AS role_assistant, CASE WHEN m = 1 THEN 1 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END AS loss_zero, CASE WHEN m = 8 THEN 3 ELSE 0 END AS media_image FROM ds""")
def a09(spark, sf):
    return D.record_summary(data_records(spark, sf)).select("ordinal", "valid", "scene", "target", F.array_join("issues", ",").alias("issues"), "messages", "role_user", "role_assistant", "loss_zero", "media_image")


@query("a10_scenes", f"WITH {DS} SELECT 'scene' AS dimension, scene AS value, count(*) AS records FROM ds GROUP BY 2 UNION ALL SELECT 'target', target, count(*) FROM ds GROUP BY 2 UNION ALL SELECT 'issue', i, count(*) FROM (SELECT unnest(string_split(issues, ',')) AS i FROM ds) WHERE i <> '' GROUP BY 2")
def a10(spark, sf):
    return D.counts(D.record_summary(data_records(spark, sf)))


@query("a11_token_checks", f"WITH {DS} SELECT ordinal, 'input_ids' AS field, 3 AS length, 0 AS non_integer, 1 AS negative100 FROM ds WHERE m = 6 UNION ALL SELECT ordinal, 'labels', 2 + doc_id % 2, 0, 0 FROM ds WHERE m = 6")
def a11(spark, sf):
    s = D.record_summary(data_records(spark, sf)).select("ordinal", F.explode("sequences").alias("s"))
    return s.select("ordinal", "s.field", "s.length", "s.non_integer", "s.negative100")


@query("a12_dataset_totals", f"""WITH {DS} SELECT count(*) FILTER (m <> 7) AS valid, count(*) FILTER (m = 7) AS invalid, sum(CASE m WHEN 1 THEN 2 WHEN 8 THEN 3 ELSE 0 END) AS messages,
  count(*) FILTER (m = 8) AS role_unknown, sum(CASE WHEN m = 8 THEN 3 ELSE 0 END) AS media_image, count(*) FILTER (m = 1 AND doc_id % 3 <> 0) AS loss_positive FROM ds""")
def a12(spark, sf):
    return D.totals(D.record_summary(data_records(spark, sf))).select("valid", "invalid", "messages", "role_unknown", "media_image", "loss_positive")


@query("a12_lengths", f"WITH {DS}, l AS (SELECT 'input_ids' AS field, 3 AS n FROM ds WHERE m = 6 UNION ALL SELECT 'labels', 2 + doc_id % 2 FROM ds WHERE m = 6 UNION ALL SELECT 'token_count', 3 + doc_id % 4 FROM ds WHERE m = 6) SELECT field, count(*) AS records, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean FROM l GROUP BY 1")
def a12b(spark, sf):
    return D.lengths(D.record_summary(data_records(spark, sf)))


@query("a12_categories", f"""WITH {DS}, c AS (SELECT ordinal, 'language' AS field, lang AS value FROM ds WHERE m IN (0, 5) UNION ALL SELECT ordinal, 'split', source FROM ds WHERE m = 1 UNION ALL SELECT ordinal, 'category', source FROM ds WHERE m = 3 UNION ALL SELECT ordinal, 'label', CAST(doc_id % 7 AS VARCHAR) FROM ds WHERE m = 5),
  g AS (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY min(ordinal), value) AS rn FROM c GROUP BY 1, 2) SELECT field, CASE WHEN rn <= 5 THEN value END AS value, CAST(sum(n) AS BIGINT) AS records FROM g GROUP BY 1, 2""")
def a12c(spark, sf):
    return D.categories(D.record_summary(data_records(spark, sf)), 5)


def call_records(spark, sf):
    """Function-calling benchmark rows derived from parts."""
    text = """to_json(named_struct('id', 'simple_' || p_partkey, 'multi_turn', p_size % 2 = 0, 'functions', CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '[{' ELSE
        '[{"name":"' || p_brand || '","parameters":{"required":["a","b"]}},{"function":{"name":"g"}},{"x":1}]' END, 'tools', '[]',
      'turns', '[[{"role":"user","content":"' || p_name || '"},{"role":"assistant"}],[{"role":"User"}]]', 'ground_truth', if(p_partkey % 3 = 0, '{"a":["f(1)"]}', '[["f(1)","g()"],["h()"]]'),
      'missed_functions', if(p_partkey % 4 = 0, '{"2":[[{"name":"f{","note":""}],["a\\\\"}"]],"{":{}}', null), 'initial_config', if(p_partkey % 2 = 0, '{"a":{"b":{"c":[{"d":{}}]}},"e":1}', null),
      'language', p_type, 'test_category', 'simple', 'subset', if(p_partkey % 7 = 0, null, 'live'), 'involved_classes', array(p_brand, p_type, p_brand)))"""
    p = spread(table(spark, sf, "part"))
    return parse_texts(p.select(F.lit("calls").alias("source_id"), F.col("p_partkey").alias("ordinal"), F.expr(text).alias("text")))


CALLS = """cs AS (SELECT p_partkey AS ordinal, CASE p_partkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'malformed' ELSE 'valid' END AS functions_state, CASE WHEN p_partkey % 5 > 1 THEN 3 ELSE 0 END AS functions_definitions,
  CASE WHEN p_partkey % 5 > 1 THEN 2 ELSE 0 END AS functions_valid, CASE WHEN p_partkey % 5 > 1 THEN 1 ELSE 0 END AS functions_parameters, CASE WHEN p_partkey % 5 > 1 THEN 2 ELSE 0 END AS functions_required,
  2 AS turns, 3 AS turn_messages, 2 AS user_messages, 1 AS assistant_messages, 0 AS invalid_turns, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS ground_truth_groups, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 3 END AS ground_truth_calls,
  CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END AS missed_functions_groups, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END AS missed_functions_calls, CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE 0 END AS missed_functions_objects,
  CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS config_keys, CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END AS config_objects, 3 AS class_values, 2 AS classes, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END AS multi_turn,
  concat_ws(',', CASE WHEN p_partkey % 7 = 0 THEN 'missing-field' END, CASE WHEN p_partkey % 5 = 1 THEN 'malformed-json' END, CASE WHEN p_partkey % 5 > 1 THEN 'invalid-definition' END) AS issues,
  p_type, p_partkey % 5 = 0 AND p_partkey % 7 <> 0 AS valid FROM part)"""
COUNTS = ["functions_definitions", "functions_valid", "functions_parameters", "functions_required", "turns", "turn_messages", "user_messages", "assistant_messages", "invalid_turns", "ground_truth_groups",
          "ground_truth_calls", "missed_functions_groups", "missed_functions_calls", "missed_functions_objects", "config_keys", "config_objects", "class_values", "classes"]


@query("a13_call_record_summary", f"WITH {CALLS} SELECT * EXCLUDE (p_type) FROM cs")
def a13(spark, sf):
    return D.call_summary(call_records(spark, sf)).select("ordinal", "functions_state", *COUNTS, "multi_turn", F.array_join("issues", ",").alias("issues"), "valid")


@query("a14_is_call_benchmark", "SELECT 'calls' AS source, count(*) AS recognized FROM part UNION ALL SELECT 'data', 0 FROM (SELECT count(*) FROM documents)")
def a14(spark, sf):
    both = call_records(spark, sf).unionByName(data_records(spark, sf))
    return both.groupBy(F.col("source_id").alias("source")).agg(F.count_if(D.is_call_benchmark(F.col("value"))).alias("recognized"))


@query("a15_call_totals", f"""WITH {CALLS} SELECT count(*) AS recognized, count(*) FILTER (valid) AS valid, count(*) FILTER (multi_turn = 'true') AS multi_turn_true, count(*) FILTER (multi_turn = 'false') AS multi_turn_false,
  count(*) AS functions_records, count(*) FILTER (ordinal % 4 = 0) AS missed_functions_records, {', '.join(f'sum({c})::BIGINT AS {c}' for c in COUNTS)} FROM cs""")
def a15(spark, sf):
    return D.call_totals(D.call_summary(call_records(spark, sf))).select("recognized", "valid", "multi_turn_true", "multi_turn_false", "functions_records", "missed_functions_records", *COUNTS)


@query("a15_call_issues", f"WITH {CALLS} SELECT i AS issue, count(*) AS records FROM (SELECT unnest(string_split(issues, ',')) AS i FROM cs) WHERE i <> '' GROUP BY 1")
def a15_issues(spark, sf):
    return D.call_issues(D.call_summary(call_records(spark, sf)))


@query("a15_call_categories", f"""WITH {CALLS}, c AS (SELECT ordinal, 'language' AS field, p_type AS value FROM cs UNION ALL SELECT ordinal, 'test_category', 'simple' FROM cs UNION ALL SELECT ordinal, 'subset', 'live' FROM cs WHERE ordinal % 7 <> 0),
  g AS (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY min(ordinal), value) AS rn FROM c GROUP BY 1, 2) SELECT field, CASE WHEN rn <= 32 THEN value END AS value, sum(n)::BIGINT AS records FROM g GROUP BY 1, 2""")
def a15_categories(spark, sf):
    return D.call_categories(D.call_summary(call_records(spark, sf)))


@query("p05_row_parts", f"""WITH {CALLS}, {DS} SELECT 'calls' AS source_id, ordinal, 'unknown' AS scene, functions_definitions, ground_truth_calls, NULL::VARCHAR AS signal, true AS talk FROM cs
  UNION ALL SELECT 'data', ordinal, scene, NULL, NULL, NULL, true FROM ds""")
def p05(spark, sf):
    both = call_records(spark, sf).unionByName(data_records(spark, sf))
    out = R.with_parts(both, conversation=True, dataset=True, profile="opentelemetry")
    return out.select("source_id", "ordinal", "dataset.scene", "calls.functions_definitions", "calls.ground_truth_calls", "telemetry.signal", F.col("conversation").isNotNull().alias("talk"))


def shape_records(spark, sf, constant: bool = False):
    """One training record per document in one of nine shapes, or all in one shape."""
    text = """CASE doc_id % 9 WHEN 0 THEN to_json(named_struct('messages', array(named_struct('role', 'user', 'content', text))))
      WHEN 1 THEN to_json(named_struct('messages', array(named_struct('role', 'tool', 'content', text), named_struct('role', 'user', 'content', lang))))
      WHEN 2 THEN '{"messages":[{"role":"user","content":[{"type":"image_url"}]}]}' WHEN 3 THEN '{"messages":[{"role":"tool","content":[{"type":"image"}]}]}'
      WHEN 4 THEN '{"chosen_messages":[1],"rejected_messages":[2,3]}' WHEN 5 THEN to_json(named_struct('conversations', array(named_struct('from', 'human', 'value', text))))
      WHEN 6 THEN to_json(named_struct('conversation', array(named_struct('human', lang, 'assistant', text)), 'category', source)) WHEN 7 THEN to_json(named_struct('input', lang, 'predict', text, 'target', if(doc_id % 2 = 0, text, null)))
      ELSE to_json(named_struct('task', lang, 'action_list', array(1, 2))) END"""
    if constant:
        text = "to_json(named_struct('messages', array(named_struct('role', 'user', 'content', text))))"
    d = spread(table(spark, sf, "documents"))
    return parse_texts(d.select(F.lit("one" if constant else "many").alias("source_id"), F.col("doc_id").alias("ordinal"), F.expr(text).alias("text")))


@query("a16_dataset_shape", """SELECT doc_id AS ordinal, CASE doc_id % 9 WHEN 0 THEN 'sft' WHEN 1 THEN 'tool-use' WHEN 2 THEN 'multimodal' WHEN 3 THEN 'conflict' WHEN 4 THEN 'preference' WHEN 5 THEN 'sharegpt'
  WHEN 6 THEN 'sft-master-conversation' WHEN 7 THEN CASE WHEN doc_id % 2 = 0 THEN 'keyword-result' END ELSE 'virtualhome' END AS shape FROM documents""")
def a16(spark, sf):
    return shape_records(spark, sf).select("ordinal", D.shape(F.col("value")).alias("shape"))


@query("a17_detect_shape", "SELECT 'one' AS source_id, 'sft' AS shape, NULL::VARCHAR AS fallback FROM (SELECT count(*) FROM documents) UNION ALL SELECT 'many', NULL, 'conflicting_shapes' FROM (SELECT count(*) FROM documents)")
def a17(spark, sf):
    return D.detect_shape(shape_records(spark, sf).unionByName(shape_records(spark, sf, True)))


@query("a18_shape_fields", """SELECT field, count(*) AS records, sum(n)::BIGINT AS entries FROM (
  SELECT 'messages' AS field, CASE doc_id % 9 WHEN 1 THEN 2 ELSE 1 END AS n FROM documents WHERE doc_id % 9 IN (0, 1, 2) UNION ALL SELECT unnest(['chosen_messages', 'rejected_messages']), unnest([1, 2]) FROM documents WHERE doc_id % 9 = 4
  UNION ALL SELECT 'conversations', 1 FROM documents WHERE doc_id % 9 = 5 UNION ALL SELECT unnest(['conversation', 'category']), 1 FROM documents WHERE doc_id % 9 = 6
  UNION ALL SELECT unnest(['input', 'predict', 'target']), 1 FROM documents WHERE doc_id % 9 = 7 AND doc_id % 2 = 0 UNION ALL SELECT unnest(['task', 'action_list']), unnest([1, 2]) FROM documents WHERE doc_id % 9 = 8) GROUP BY 1""")
def a18(spark, sf):
    return D.shape_fields(shape_records(spark, sf)).groupBy("field").agg(F.count(F.lit(1)).alias("records"), F.sum("count").cast("bigint").alias("entries"))
