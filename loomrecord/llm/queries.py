"""One registered query per operator, over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrecord.llm.common import documents
from loomrecord.llm.decontaminate import contamination
from loomrecord.llm.line_crf import score_quality, train
from loomrecord.llm.line_dedup import remove_repeated_lines
from loomrecord.llm.near_dedup import near_duplicates
from loomrecord.llm.packing import pack
from loomrecord.llm.pii import KINDS, find_pii, span_text
from loomrecord.llm.quality_rules import apply_rules
from loomrecord.llm.substring_dedup import remove_repeats
from loomrecord.llm.token_align import align_tokenizers
from loomrecord.llm.token_count import count_tokens
from loomrecord.llm.tree_bpe import encode_decode
from loomrecord.llm.vector_search import top_k
from loomrecord.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def op1_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=False)
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept")


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.size(f"pii.{k}").cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(KINDS).cast("binary"), 256).alias("base_sha256"), span_text((*KINDS, "id")).alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated_lines(documents(spark, sf_dir))
    return left.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir))


CHECKS["op2_substring_dedup"] = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), x -> x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w),
g AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM p),
f AS (SELECT g, min(doc_id) AS lo FROM g GROUP BY g),
hit AS (SELECT doc_id, i FROM g JOIN f USING (g) WHERE lo < doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, (x, i) -> NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
CHECKS["op6_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, x -> floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.v) = 0 THEN 0 ELSE list_inner_product(q.v, c.v) END::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5
"""
CHECKS["op12_decontamination"] = r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
t AS (SELECT side, id, list_slice(w, CASE WHEN w[1] = '' THEN 2 ELSE 1 END, len(w) - CASE WHEN len(w) > 1 AND w[len(w)] = '' THEN 1 ELSE 0 END) AS w FROM w),
b AS (SELECT id, w, least(len(w), 10) AS m FROM t WHERE side = 'b' AND len(w) > 0),
bw AS (SELECT DISTINCT id, m, list_slice(w, i, i + m - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
d AS (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT * FROM t, (SELECT DISTINCT m FROM bw) WHERE side = 'd' AND len(w) >= m)),
h AS (SELECT d.id, d.i, d.m, bw.id AS item FROM d JOIN bw ON d.m = bw.m AND list_slice(d.w, d.i, d.i + d.m - 1) = bw.g),
c AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT id, i, m FROM h)) GROUP BY id),
k AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM h) GROUP BY id)
SELECT t.id AS doc_id, coalesce(len(t.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN c ON t.id = c.id LEFT JOIN k ON t.id = k.id WHERE t.side = 'd'
"""

for _query in (op1_line_crf_quality, op2_substring_dedup, op3_token_counts, op4_quality_rules, op5_contextual_pii, op6_exact_top_k, op7_line_dedup, op8_best_fit_packing, op9_byte_bpe, op10_minhash_near_dedup, op11_embedding_whitening, op12_decontamination, op13_tokenizer_alignment):
    QUERIES[_query.__name__] = _query
