"""Category counts and time buckets over selected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.functions.times import MAX_SAFE, bucket_start, ms_text, text_to_ms, to_epoch_ms

# Texts that stand for "not known".
UNKNOWN_TEXTS = ["unknown", "<unknown>", "(unknown)"]
MAX_KEY_LENGTH = 256  # cap: longer labels count as unknown


def _text_state_sql(text: str) -> str:
    body = f"lower(regexp_replace({text}, {J.sql_text(f'^{J.BLANK_CLASS}+|{J.BLANK_CLASS}+$')}, ''))"
    listed = ", ".join(J.sql_text(t) for t in ["", *UNKNOWN_TEXTS])
    return f"CASE WHEN {text} IS NULL THEN 'missing' WHEN {body} IN ({listed}) THEN 'unknown' ELSE 'value' END"


def _number_state_sql(n: str) -> str:
    bad = f"isnan({n}) OR abs({n}) = double('inf') OR (abs({n}) > {MAX_SAFE}D AND {n} % 1 = 0)"
    return f"CASE WHEN {n} IS NULL THEN 'missing' WHEN {bad} THEN 'unknown' ELSE 'value' END"


def _selected_sql(state: str, typ: str, label: str) -> str:
    return J.bind_sql(state, "st", f"named_struct('state', st, 'type', if(st = 'value', {typ}, null), 'label', if(st = 'value', {label}, null))")


def select_text(text: Column) -> Column:
    """A1 for a normalised string column."""
    return J.let_sql(text, _selected_sql(_text_state_sql("v"), "'string'", "v"))


def select_event_kind(kind: Column) -> Column:
    """A1 for the event kind: `other` carries no information."""
    return select_text(F.when(kind == "other", "unknown").otherwise(kind))


def select_number(number: Column) -> Column:
    """A1 for a normalised numeric column."""
    return J.let_sql(number, _selected_sql(_number_state_sql("v"), "'number'", "regexp_replace(cast(v AS string), '[.]0$', '')"))


def select_value(value: Column) -> Column:
    """A1: struct(state, type, label) of a variant: value, missing or unknown."""
    text = "try_variant_get(v, '$', 'string')"
    kind = (
        "CASE WHEN schema_of_variant(v) IN ('STRING', 'BOOLEAN') THEN lower(schema_of_variant(v)) "
        "WHEN schema_of_variant(v) rlike '^(BIGINT|DOUBLE|DECIMAL)' THEN 'number' END"
    )
    number = J.bind_sql("try_variant_get(v, '$', 'double')", "n", _number_state_sql("n"))
    state = (
        f"CASE WHEN v IS NULL OR is_variant_null(v) THEN 'missing' WHEN ty = 'string' THEN {_text_state_sql(text)} "
        f"WHEN ty = 'boolean' THEN 'value' WHEN ty = 'number' THEN {number} ELSE 'unknown' END"
    )
    label = f"if(ty = 'number', regexp_replace({text}, '[.]0$', ''), {text})"
    return J.let_sql(value, J.bind_sql(kind, "ty", _selected_sql(state, "ty", label)))


def _keyed(selected: Column, max_key_length: int = MAX_KEY_LENGTH) -> Column:
    """struct(kind, type, label); labels over the key length count as unknown."""
    kind = f"if(length(s.label) > {max_key_length}, 'unknown', s.state)"
    cut = "named_struct('kind', k, 'type', if(k = 'value', s.type, null), 'label', if(k = 'value', s.label, null))"
    return J.let_sql(selected, J.bind_sql(kind, "k", cut), "s")


def selector(name: str | list, dimension: bool = False) -> Column:
    """Selected value of an event field, a derived field or a record path."""
    from loomrecord.operators.where import event_field

    if isinstance(name, list):
        return select_value(J.get(F.col("value"), *name))
    if name == "event_kind":
        return select_event_kind(F.col(name))
    typ, col = event_field(name)
    if typ == "string":
        return select_text(col)
    return select_number(col) if typ == "number" else select_value(col)


def _ranked(groups: DataFrame, capacity: int) -> DataFrame:
    """Mark the groups kept by first appearance.

    The first `capacity` groups are found by a top-k over the pre-aggregated groups
    and joined back as a small side, so no task sorts an unbounded set of groups.
    """
    kept = groups.filter(F.col("kind") == "value").orderBy("first", "type", "label").limit(capacity)
    return kept


def _place(df: DataFrame, order: str) -> list[Column]:
    """What decides which value was seen first: the source, if rows have one, then `order`."""
    source = F.col("source_id") if "source_id" in df.columns else F.lit(None).cast("string")
    return [source.alias("_s"), F.col(order).alias("_o")]


def _grouped(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and first places per group: first per source with plain numbers, then over the few sources."""
    rows = rows if "_s" in rows.columns else rows.withColumn("_s", F.lit(None).cast("string"))
    parts = rows.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("o"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("count"), F.min(F.struct("_s", "o")).alias("first"))


def category_counts(df: DataFrame, selected: Column, max_groups: int = 32, order: str = "ordinal", max_key_length: int = MAX_KEY_LENGTH) -> DataFrame:
    """A2: exact counts of the first-seen keys; the rest is Other; Unknown and Missing are reserved.

    Keys are tagged by type (1 differs from "1"). First-seen means the smallest
    source, then `order` value, so the answer does not depend on partitioning.
    """
    keyed = df.select(*_place(df, order), F.inline(F.array(_keyed(selected, max_key_length))))
    groups = _grouped(keyed, "kind", "type", "label")
    return _fold(groups, max_groups - 3)


def _fold(groups: DataFrame, capacity: int) -> DataFrame:
    kept = _ranked(groups, capacity).select("type", "label", F.lit(True).alias("kept"))
    folded = groups.join(F.broadcast(kept), ["type", "label"], "left")  # at most `capacity` rows
    kind = F.when((F.col("kind") == "value") & F.col("kept").isNull(), "other").otherwise(F.col("kind"))
    named = folded.select(
        kind.alias("kind"),
        F.when(kind == "value", F.col("type")).alias("type"),
        F.when(kind == "value", F.col("label")).otherwise(F.initcap(kind)).alias("label"),
        "count", "first",
    )
    out = named.groupBy("kind", "type", "label").agg(F.sum("count").cast("bigint").alias("count"), F.min("first").alias("first"))
    rank = F.element_at(F.expr("map('value', 0, 'other', 1, 'unknown', 2, 'missing', 3)"), F.col("kind"))
    by_count = F.when(F.col("kind") == "value", -F.col("count"))
    return out.orderBy(rank, by_count, "first").select("kind", "type", "label", "count")


def category_top(df: DataFrame, selected: Column, k: int) -> DataFrame:
    """A3: the k most frequent values, exact."""
    sel = df.select(F.inline(F.array(_keyed(selected))))
    return sel.filter(F.col("kind") == "value").groupBy("type", "label").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "type", "label").limit(k)


def time_buckets(df: DataFrame, value: Column, width_ms: int, unit: str = "auto", max_buckets: int = 512, order: str = "ordinal", is_text: bool = False) -> DataFrame:
    """A4: counts per half-open bucket, first-seen buckets kept, ascending; then Overflow, Unknown, Missing."""
    state = select_text(value)["state"] if is_text else select_value(value)["state"]
    ms = text_to_ms(value, unit) if is_text else to_epoch_ms(value, unit)
    sel = df.select(*_place(df, order), F.inline(F.array(F.struct(state.alias("state"), ms.alias("ms")))))
    return bucket_counts(sel, width_ms, max_buckets)


def bucket_counts(sel: DataFrame, width_ms: int, max_buckets: int = 512) -> DataFrame:
    """A4 over prepared columns _o (and _s, the source), state, ms."""
    start = bucket_start(F.col("ms"), width_ms)
    kind = F.when(F.col("state") != "value", F.col("state")).when(F.col("ms").isNull(), "unknown").otherwise("value")
    place = [c for c in ("_s", "_o") if c in sel.columns]
    groups = _grouped(sel.select(*place, kind.alias("kind"), F.when(kind == "value", start).alias("start_ms")), "kind", "start_ms")
    kept = groups.filter(F.col("kind") == "value").orderBy("first", "start_ms").limit(max_buckets - 3).select("start_ms", F.lit(True).alias("kept"))
    folded = groups.join(F.broadcast(kept), "start_ms", "left")
    final = F.when((F.col("kind") == "value") & F.col("kept").isNull(), "overflow").when(F.col("kind") == "value", "time").otherwise(F.col("kind"))
    out = folded.select(final.alias("kind"), F.when(final == "time", F.col("start_ms")).alias("start_ms"), "count")
    out = out.groupBy("kind", "start_ms").agg(F.sum("count").cast("bigint").alias("count"))
    rank = F.element_at(F.expr("map('time', 0, 'overflow', 1, 'unknown', 2, 'missing', 3)"), F.col("kind"))
    return out.orderBy(rank, "start_ms").select(
        "kind", "start_ms", (F.col("start_ms") + width_ms).alias("end_ms"),
        F.coalesce(ms_text(F.col("start_ms")), F.initcap("kind")).alias("label"), "count",
    )


def insights(events: DataFrame, width_ms: int = 300_000, max_groups: int = 32, max_buckets: int = 64, order: str = "ordinal") -> DataFrame:
    """A5: category counts of four dimensions and 5-minute buckets of one set of events.

    Every event is turned into five tagged keys and pre-aggregated in one pass;
    the folding into Other/Overflow then works on groups only. Columns: dimension,
    kind, label, start_ms, count.
    """
    dims = {
        "event_kind": select_event_kind(F.col("event_kind")),
        "severity": select_text(F.col("severity")),
        "service": select_value(F.element_at(F.col("derived"), "service")),
        "status": select_text(F.col("status")),
    }
    tagged = [
        J.let_sql(_keyed(s), f"named_struct('dimension', '{d}', 'kind', v.kind, 'type', v.type, 'label', v.label, 'start_ms', cast(null AS bigint))")
        for d, s in dims.items()
    ]
    raw = F.col("timestamp_raw")
    time = F.struct(select_text(raw)["state"].alias("state"), bucket_start(text_to_ms(raw), width_ms).alias("start"))
    tagged.append(J.let(time, lambda t: F.struct(
        F.lit("time").alias("dimension"), F.when((t["state"] == "value") & t["start"].isNull(), "unknown").otherwise(t["state"]).alias("kind"),
        F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("label"), t["start"].alias("start_ms"))))
    rows = events.select(*_place(events, order), F.explode(F.array(*tagged)).alias("t")).select("_s", "_o", "t.*")
    groups = _grouped(rows, "dimension", "kind", "type", "label", "start_ms")
    w = Window.partitionBy("dimension").orderBy("first", "type", "label", "start_ms")
    cap = F.when(F.col("dimension") == "time", max_buckets - 3).otherwise(max_groups - 3)
    # row_number below a constant bound: Spark keeps only the leading rows of each partition before the shuffle.
    head = groups.filter(F.col("kind") == "value").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(max_groups, max_buckets) - 3).filter(F.col("rn") <= cap)
    head = head.select("dimension", F.coalesce("type", F.lit("")).alias("jt"), F.coalesce("label", F.lit("")).alias("jl"), F.coalesce("start_ms", F.lit(0)).alias("js"), F.lit(True).alias("kept"))
    keyed = groups.withColumns({"jt": F.coalesce("type", F.lit("")), "jl": F.coalesce("label", F.lit("")), "js": F.coalesce("start_ms", F.lit(0))})
    # The head holds at most 4 * (max_groups - 3) + (max_buckets - 3) rows.
    folded = keyed.join(F.broadcast(head), ["dimension", "jt", "jl", "js"], "left")
    over = F.when(F.col("dimension") == "time", "overflow").otherwise("other")
    final = F.when((F.col("kind") == "value") & F.col("kept").isNull(), over).otherwise(F.col("kind"))
    return (
        folded.select("dimension", final.alias("kind"), F.when(final == "value", F.col("label")).alias("label"),
                      F.when(final == "value", F.col("start_ms")).alias("start_ms"), "count")
        .groupBy("dimension", "kind", "label", "start_ms").agg(F.sum("count").cast("bigint").alias("count"))
    )
