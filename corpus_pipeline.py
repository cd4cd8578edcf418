"""Documents to packed sequences: rules, repeated lines, near duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrecord.llm.common import documents, written
from loomrecord.llm.line_dedup import remove_repeated_lines
from loomrecord.llm.near_dedup import keep_one
from loomrecord.llm.packing import pack
from loomrecord.llm.pii import find_pii, redact
from loomrecord.llm.quality_rules import apply_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars measured anew."""
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null and empty texts fail the base."""
    return apply_rules(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document of which no word is left goes with them."""
    left = remove_repeated_lines(docs.select(*COLUMNS))
    gone = (F.col("line_dedup.n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _sized(left.where(~F.coalesce(gone, F.lit(False))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the smallest doc_id."""
    return keep_one(docs.select(*COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return _sized(redact(find_pii(docs.select(*COLUMNS))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence."""
    return pack(docs.select(*COLUMNS))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]
#: Certified cutoffs, similarity classes and packing have no statement in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
