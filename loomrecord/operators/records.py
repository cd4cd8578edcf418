"""Records: one row per physical line, with its parse state, value and problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.functions.jsonvalue import BLANK_CLASS, fence

MAX_RECORD_BYTES = 1 << 20  # cap: longer records are reported, not parsed


def strict_parse(text: Column) -> Column:
    """ARRAY of one VARIANT: the text's value, or NULL unless it is exactly one JSON value.

    try_parse_json stops after the first value, so the text is parsed inside an
    array in front of a sentinel: only a text that is one whole value leaves the
    sentinel in the second and last place. One parse, no Python. Fence the
    result, so that the value is parsed once however often it is used.
    """
    mark = F.xxhash64(text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))

    def unwrap(w: Column) -> Column:
        whole = (F.try_variant_get(w, "$[1]", "bigint") == mark) & F.try_variant_get(w, "$[2]", "variant").isNull()
        return F.when(whole, F.try_variant_get(w, "$[0]", "variant"))

    return F.transform(F.array(wrapped), unwrap)


def is_blank(text: Column) -> Column:
    return text.rlike(f"^{BLANK_CLASS}*$")


def _problem(code: str, severity: str, message: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(severity).alias("severity"))


def classify(df: DataFrame, raw: str | None = None, max_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """S3: add content_len, text, value, parse_state and problems.

    `df` holds source_id, ordinal and either `text` (STRING) or the column named
    by `raw` (BINARY content without its delimiter). Order of the tests:
    oversized, encoding error, blank, invalid JSON, valid. A byte-order mark is
    removed on ordinal 0 only.
    """
    body = F.col(raw) if raw else F.col("text").cast("binary")
    df = df.withColumn("content_len", F.octet_length(body).cast("bigint"))
    if raw:
        df = df.withColumn("utf8_ok", F.is_valid_utf8(F.col(raw).cast("string")))
        text = F.when(F.col("utf8_ok"), F.col(raw).cast("string"))
    else:
        df = df.withColumn("utf8_ok", F.is_valid_utf8("text"))
        text = F.when(F.col("utf8_ok"), F.col("text"))
    bom = (F.col("ordinal") == 0) & text.startswith("﻿")
    df = df.withColumn("has_bom", F.coalesce(bom, F.lit(False)))
    df = df.withColumn("text", F.when(F.col("has_bom"), F.substring(text, 2, 2**31 - 1)).otherwise(text))
    fits = F.col("content_len") <= max_bytes
    readable = F.when(fits, F.col("text"))
    df = fence(df, value=strict_parse(readable)[0])
    state = (
        F.when(~fits, "oversized")
        .when(~F.col("utf8_ok"), "encoding_error")
        .when(is_blank(F.col("text")), "blank")
        .when(F.col("value").isNull(), "invalid_json")
        .otherwise("valid")
    )
    df = df.withColumn("parse_state", state)
    st = F.col("parse_state")
    problems = F.filter(
        F.array(
            F.when(st == "oversized", _problem("OVERSIZED_RECORD", "warning", "Record is longer than the inspection limit")),
            F.when(st == "encoding_error", _problem("INVALID_UTF8", "error", "Record is not valid UTF-8")),
            F.when(F.col("has_bom") & (st != "oversized"), _problem("BOM", "notice", "Byte-order mark removed")),
            F.when(st == "blank", _problem("BLANK_RECORD", "warning", "Record is blank")),
            F.when(st == "invalid_json", _problem("INVALID_JSON", "error", "Record is not one JSON value")),
        ),
        lambda p: p.isNotNull(),
    )
    return df.withColumn("problems", problems).drop("utf8_ok", "has_bom")


def parse_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Fast path for text columns already known to be JSON: adds `value` and `parse_state`."""
    out = fence(df, value=strict_parse(F.col(text))[0])
    return out.withColumn("parse_state", F.when(F.col("value").isNull(), "invalid_json").otherwise("valid"))


def problems(records: DataFrame, descending: bool = False) -> DataFrame:
    """One row per problem in physical order; entries of one record stay together."""
    order = F.col("ordinal").desc() if descending else F.col("ordinal").asc()
    rows = records.filter(F.size("problems") > 0).select("source_id", "ordinal", F.posexplode("problems").alias("entry", "p"))
    return rows.select("source_id", "ordinal", "entry", "p.code", "p.message", "p.severity").orderBy("source_id", order, "entry")


def document_summary(records: DataFrame) -> DataFrame:
    """Records, bytes and state counts per source."""
    delim = F.col("delim_len") if "delim_len" in records.columns else F.lit(0)
    def states(name: str) -> Column:
        return F.count_if(F.col("parse_state") == name)
    return records.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.col("content_len") + delim).cast("bigint").alias("bytes"),
        states("valid").alias("valid"),
        states("blank").alias("blank"),
        states("invalid_json").alias("invalid_json"),
        states("encoding_error").alias("encoding_errors"),
        states("oversized").alias("oversized"),
        F.sum(F.size("problems")).cast("bigint").alias("problems"),
    )


COORDINATES = ["source_id", "generation", "ordinal", "byte_start", "byte_end"]


def get_records(records: DataFrame, refs: DataFrame, on: list[str] = COORDINATES) -> DataFrame:
    """The records whose coordinates all equal a reference's."""
    return records.join(refs.select(*on).dropDuplicates(), on, "left_semi")


def stale_refs(records: DataFrame, refs: DataFrame, on: list[str] = COORDINATES) -> DataFrame:
    """References that match no current record."""
    return refs.join(records.select(*on), on, "left_anti")


def record_text(content: Column, content_len: Column, max_bytes: int) -> Column:
    """struct(text, complete): exact text when it fits and is UTF-8, else empty."""
    fits = content_len <= max_bytes
    ok = fits & F.is_valid_utf8(content.cast("string"))
    return F.struct(
        F.when(ok, content.cast("string")).otherwise(F.lit("")).alias("text"),
        F.coalesce(ok, F.lit(False)).alias("complete"),
    )


def record_summary(text: Column, state: Column, max_chars: int = 240) -> Column:
    """One-line label of a record, led by its state when it did not parse."""
    line = F.substring(F.trim(F.regexp_replace(text, r"[\x00-\x1f\x7f\s]+", " ")), 1, max_chars)
    return (
        F.when(state == "valid", line)
        .when(state == "blank", F.lit("(blank record)"))
        .when(state == "oversized", F.lit("(oversized record)"))
        .when(state == "encoding_error", F.lit("(invalid UTF-8)"))
        .otherwise(F.concat(F.lit("(invalid JSON) "), line))
    )
