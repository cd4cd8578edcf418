"""Projection, ordering and paging of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.operators.where import EVENT_FIELDS, USAGE_FIELDS
from loomrecord.session import materialize

# Alphabetical rank of the kind names; both numeric kinds share one rank.
KIND_RANK = {"array": 1, "boolean": 2, "integer": 3, "number": 3, "object": 4, "string": 5}


def page_forward(df: DataFrame, after: int, limit: int) -> DataFrame:
    """O1: rows with ordinal above the anchor, plus `has_after` from one probed row."""
    probe = df.filter(F.col("ordinal") > after).orderBy("ordinal").limit(limit + 1)
    return _trim(probe, limit, F.col("ordinal").asc(), "has_after")


def page_backward(df: DataFrame, before: int, limit: int) -> DataFrame:
    """O2: the rows just below the anchor, returned ascending, plus `has_before`."""
    probe = df.filter(F.col("ordinal") < before).orderBy(F.col("ordinal").desc()).limit(limit + 1)
    return _trim(probe, limit, F.col("ordinal").desc(), "has_before").orderBy("ordinal")


def _trim(probe: DataFrame, limit: int, order: Column, flag: str) -> DataFrame:
    # The window runs over limit + 1 rows only.
    w = Window.orderBy(order)
    ranked = probe.withColumn("_rn", F.row_number().over(w)).withColumn(flag, F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return ranked.filter(F.col("_rn") <= limit).drop("_rn")


def page_by_ordinal(df: DataFrame, offset: int, limit: int, descending: bool = False) -> DataFrame:
    """O3: an offset page in physical order."""
    order = F.col("ordinal").desc() if descending else F.col("ordinal").asc()
    return df.orderBy(order).offset(offset).limit(limit)


def matched_total(df: DataFrame) -> DataFrame:
    """Total matches beside a page."""
    return df.agg(F.count(F.lit(1)).alias("matched"))


SORT_KEYS = ["_kind_rank", "_number_key", "_boolean_key", "_text_key"]


def with_sort_keys(df: DataFrame, path: list, text: str = "text", value: str = "value") -> DataFrame:
    """`_is_missing` and SORT_KEYS, comparable key columns of a mixed-type field, each worked out once per row."""
    leaf, shape = F.col("_leaf"), F.col("_shape")
    df = J.fence(df, _leaf=J.get(F.col(value), *path))
    df = J.fence(df, _shape=F.substring_index(F.substring_index(F.schema_of_variant(leaf), "<", 1), "(", 1))
    numeric = shape.isin("BIGINT", "DOUBLE", "DECIMAL")
    rank = J.lookup({name: str(KIND_RANK[kind]) for name, kind in J.SCHEMA_KINDS.items() if kind in KIND_RANK}, shape).cast("int")
    # Re-serialised once; compact_json of the whole text is then that text's.
    df = J.fence(
        df, _is_missing=leaf.isNull() | (shape == "VOID"), _kind_rank=rank, _number_key=F.when(numeric, J.as_double(leaf)),
        _boolean_key=F.when(shape == "BOOLEAN", F.try_variant_get(leaf, "$", "boolean")),
        _raw=F.when(shape == "STRING", J.as_string(leaf)).when(shape.isin("ARRAY", "OBJECT"), F.get_json_object(text, J.jsonpath(*path, quote="'"))))
    return df.withColumn("_text_key", F.when(shape.isin("ARRAY", "OBJECT"), J.whole_numbers(F.col("_raw"))).otherwise(F.col("_raw"))).drop("_leaf", "_shape", "_raw")


def _by_keys(descending: bool) -> list[Column]:
    return [F.col("_is_missing").asc(), *[F.col(k).desc() if descending else F.col(k).asc() for k in SORT_KEYS], F.col("ordinal").asc()]


def sort_mixed(df: DataFrame, path: list, descending: bool = False, text: str = "text", value: str = "value") -> DataFrame:
    """Order by a mixed-type field; missing last and ordinal ascending in both directions."""
    return with_sort_keys(df, path, text, value).orderBy(*_by_keys(descending)).drop("_is_missing", *SORT_KEYS)


def with_positions(ordered: DataFrame, position: str = "position") -> DataFrame:
    """A sorted frame with each row's place in the whole, from 1.

    The sort deals ranges to partitions; rows are numbered inside them and shifted by
    the sizes of the partitions before. Written once, so that both passes see the same
    rows; one row per partition is all that is ever brought together.
    """
    base = (1 << 33) - 1  # of monotonically_increasing_id: the partition stands above these bits
    kept = materialize(ordered.withColumn("_row", F.monotonically_increasing_id()), "sorted")
    sizes = kept.groupBy(F.shiftright("_row", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    kept = kept.withColumn("_part", F.shiftright("_row", 33)).join(F.broadcast(sizes), "_part")
    return kept.withColumn(position, F.col("_before") + F.col("_row").bitwiseAND(base) + 1).drop("_row", "_part", "_before")


def top_page(df: DataFrame, path: list, offset: int, limit: int, descending: bool = False, key: list[str] | None = None) -> DataFrame:
    """A sorted page with late materialisation.

    Only the row key and the sort columns travel through the top-k; the wide
    record columns are fetched afterwards for the winning rows.
    """
    key = key or ["source_id", "ordinal"]
    order = _by_keys(descending)
    narrow = with_sort_keys(df, path).select(*key, "_is_missing", *SORT_KEYS)
    winners = narrow.orderBy(*order).offset(offset).limit(limit)
    ranked = winners.select(*key, F.row_number().over(Window.orderBy(*order)).alias("position"))
    return df.join(ranked, key).orderBy("position")


def resolve_sort(name: str | list) -> tuple[str, object]:
    """Where a sort column lives: system, event, derived or record path."""
    if isinstance(name, list):
        return "path", name
    if name in ("ordinal", "byte_start", "content_len", "parse_state"):
        return "system", F.col(name)
    if name in EVENT_FIELDS or name in USAGE_FIELDS:
        return "event", F.col(name)
    if name.startswith("derived."):
        return "derived", F.element_at(F.col("derived"), name.removeprefix("derived."))
    return "path", [name]


def sort_by(df: DataFrame, name: str | list, descending: bool = False) -> DataFrame:
    """Sort by a resolved column; absent values last, ordinal as the tie-break."""
    where, target = resolve_sort(name)
    if where == "path":
        return sort_mixed(df, target, descending)
    if where == "derived":
        return sort_mixed(df.withColumn("_d", target).withColumn("_t", J.as_string(F.col("_d"))), [], descending, "_t", "_d").drop("_d", "_t")
    col = target.desc_nulls_last() if descending else target.asc_nulls_last()
    return df.orderBy(col, F.col("ordinal").asc())


def running_bytes(df: DataFrame, size: str = "content_len", blocks: int = 1 << 16) -> DataFrame:
    """Cumulative bytes per source in ordinal order, without one task per source.

    Ordinals are cut into blocks; block totals are summed per source (one small row
    per block) and added to the running sum inside each block.
    """
    cut = df.withColumn("_block", F.floor(F.col("ordinal") / blocks))
    totals = cut.groupBy("source_id", "_block").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy("source_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_id", "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source_id", "_block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(totals, ["source_id", "_block"]).withColumn("cumulative", (F.sum(size).over(inside) + F.col("_base")).cast("bigint"))
    return joined.drop("_block", "_base")


def within_bytes(df: DataFrame, max_bytes: int, size: str = "content_len") -> DataFrame:
    """Rows until the next one would exceed the limit; the first row is always kept."""
    run = running_bytes(df, size)
    first = df.groupBy("source_id").agg(F.min("ordinal").alias("_first"))
    return run.join(first, "source_id").filter((F.col("cumulative") <= max_bytes) | (F.col("ordinal") == F.col("_first"))).drop("_first")


def raw_page(df: DataFrame, start: int, limit: int, max_bytes: int) -> DataFrame:
    """Rows from `start` until the row or byte limit, with `next_ordinal` and `reason`.

    An empty result for a non-empty range means that the first row alone exceeds
    the byte limit.
    """
    probe = df.filter(F.col("ordinal") >= start).orderBy("ordinal").limit(limit + 1)
    w = Window.orderBy("ordinal")
    run = probe.withColumn("_rn", F.row_number().over(w)).withColumn(
        "cumulative", F.sum("content_len").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")
    )
    fits = (F.col("_rn") <= limit) & (F.col("cumulative") <= max_bytes)
    everything = Window.partitionBy()
    run = run.withColumn("_next", F.min(F.when(~fits, F.struct("ordinal", (F.col("_rn") > limit).alias("by_rows")))).over(everything))
    out = run.withColumn("next_ordinal", F.col("_next.ordinal")).withColumn(
        "reason", F.when(F.col("_next").isNull(), "end").when(F.col("_next.by_rows"), "page-limit").otherwise("max-bytes")
    )
    return out.filter(fits).drop("_rn", "_next")


def budget(df: DataFrame, max_records: int, max_bytes: int) -> DataFrame:
    """Optional bounded scan report: rows and bytes inside both budgets, reason and cursor."""
    probe = df.orderBy("ordinal").limit(max_records + 1).select("ordinal", "content_len")
    w = Window.orderBy("ordinal")
    run = probe.select(
        "ordinal", F.row_number().over(w).alias("rn"),
        F.sum("content_len").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
    )
    inside = (F.col("rn") <= max_records) & (F.col("cum") <= max_bytes)
    return run.agg(
        F.count_if(inside).alias("records"),
        F.coalesce(F.max(F.when(inside, F.col("cum"))), F.lit(0)).cast("bigint").alias("bytes"),
        F.min(F.when(~inside, F.col("ordinal"))).alias("cursor"),
        F.when(F.bool_or(F.col("cum") > max_bytes) & (F.count_if(inside) < max_records), "byte-budget")
        .when(F.bool_or(F.col("rn") > max_records), "record-budget").otherwise("end").alias("reason"),
    )


def select_columns(df: DataFrame, specs: list[dict], key: tuple[str, ...] = ("source_id", "ordinal"), max_columns: int | None = None) -> DataFrame:
    """Cells for record paths, event fields or system columns; absent ones are empty. `max_columns` refuses wider projections."""
    if max_columns is not None and len(specs) > max_columns:
        raise ValueError(f"at most {max_columns} columns")
    out = []
    for spec in specs:
        if "path" in spec:
            c = J.cell(F.col("text"), F.col("value"), *spec["path"])
        else:
            where, target = resolve_sort(spec["field"])
            c = target if where in ("system", "event") else J.as_string(target)
        out.append(c.alias(spec["id"]))
    return df.select(*key, *out)


# The columns shown first for each family of records; families without an entry share that of agents.
DEFAULT_COLUMNS = {
    "generic": [],
    "opentelemetry": ["event_kind", "timestamp_raw", "severity", "summary", "derived.nestedCount", "derived.service", "derived.operation", "derived.traceCount", "derived.errorCount", "derived.durationMs", "derived.metricCount", "derived.dataPointCount"],
    "structured-application-log": ["timestamp_raw", "severity", "summary", "derived.service", "derived.logger"],
    "software-engineering-agent": ["event_kind", "summary", "derived.task", "derived.step", "derived.tool", "status"],
    "codex-history": ["event_kind", "timestamp_raw", "actor", "summary", "session_id", "derived.sourceKind"],
    "codex-session-index": ["event_kind", "timestamp_raw", "summary", "session_id", "derived.threadName", "derived.sourceKind"],
    "codex-exec-jsonl": ["event_kind", "summary", "actor", "status", "session_id", "model"],
    "codex-trace": ["event_kind", "timestamp_raw", "summary", "actor", "status", "session_id", "turn_id"],
    "agent": ["event_kind", "timestamp_raw", "actor", "summary", "status", "model"],
}


def default_columns(profile: str, requested: list[dict] = (), most: int | None = None) -> list[dict]:
    """A profile's columns, then the requested ones; the first of an id wins. `most` keeps that many."""
    base = [{"id": n.replace(".", "_"), "field": n} for n in DEFAULT_COLUMNS.get(profile, DEFAULT_COLUMNS["agent"])]
    merged: dict[str, dict] = {}
    for spec in [*base, *requested]:
        merged.setdefault(spec["id"], spec)
    return list(merged.values())[:most]
