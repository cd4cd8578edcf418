"""Observed schema: paths, kinds, presence and examples, computed as a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.functions.times import iso_to_ms
from loomrecord.session import materialize

KINDS = ["object", "array", "string", "integer", "number", "boolean", "null"]


def flatten_paths(df: DataFrame, depth: int = 4, array_entries: int = 3, key: tuple[str, ...] = ("source_id", "ordinal"), value: str = "value") -> DataFrame:
    """One row per (record, path): key columns, path, display, depth, node.

    Each step turns the rows of one depth into themselves and their children and passes
    the others on, so a record is parsed and its values are opened once. No Python and
    no shuffle.
    """
    tokens = "array<struct<key:string,idx:int>>"
    out = [*key, "path", "display", "depth", "node"]
    flat = df.filter(F.col(value).isNotNull()).select(
        *key, F.expr(f"cast(array() as {tokens})").alias("path"), F.lit("$").alias("display"), F.lit(0).alias("depth"), F.col(value).alias("node")
    )
    nothing = "cast(null AS string) AS key"
    for d in range(1, depth + 1):
        # The row itself comes first, so a child's place in its array is one less than its place here.
        steps = (f"concat(array(struct({nothing}, node AS value)), CASE WHEN depth < {d - 1} THEN array() "
                 "WHEN schema_of_variant(node) LIKE 'OBJECT%' THEN map_entries(try_variant_get(node, '$', 'map<string,variant>')) "
                 f"WHEN schema_of_variant(node) LIKE 'ARRAY%' THEN transform(slice(try_variant_get(node, '$', 'array<variant>'), 1, {array_entries}), x -> struct({nothing}, x AS value)) ELSE array() END)")
        # Outer, though no array is empty: for others a filter on the array's size is inferred, which builds it twice.
        opened = flat.select(*out, F.expr(steps).alias("_steps")).select(*out, F.posexplode_outer("_steps").alias("_pos", "_step"))
        child, name = F.col("_pos") > 0, F.col("_step.key")
        token = F.struct(name.alias("key"), F.when(name.isNull(), F.col("_pos") - 1).alias("idx"))
        flat = opened.select(
            *key,
            F.when(child, F.concat("path", F.array(token))).otherwise(F.col("path")).alias("path"),
            F.when(child, F.concat("display", J.display_step(token))).otherwise(F.col("display")).alias("display"),
            F.when(child, F.lit(d)).otherwise(F.col("depth")).alias("depth"),
            F.col("_step.value").alias("node"),
        )
    return flat


def _preview(max_chars: int):
    node = F.col("node")
    text = (
        F.when(J.is_json_null(node), F.lit("null")).when(J.is_numeric(node), J.number_text(node))
        .when(J.is_string(node) | J.is_boolean(node), J.as_string(node)).otherwise(F.to_json(node))
    )
    return F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars - 1), F.lit("…"))).otherwise(text)


def field_stats(df: DataFrame, depth: int = 4, array_entries: int = 3, examples: int = 3, example_chars: int = 80) -> DataFrame:
    """H1: per path presence, kinds, missing, nulls, first/last ordinal and examples.

    Examples are the first distinct previews in ordinal order. The pass that counts also
    takes the least ordinal of each class of previews (by hash): as soon as `examples`
    classes are met, as many different previews are, so no example begins later. Only rows
    up to that ordinal are grouped by preview; a path with fewer classes keeps all its
    rows, which are few previews unless their hashes agree.
    """
    def flat() -> DataFrame:
        rows = flatten_paths(df, depth, array_entries).select("ordinal", "display", "node")
        return rows.select("ordinal", "display", J.kind(F.col("node")).alias("kind"), _preview(example_chars).alias("preview"))

    classes = 4 * examples
    rows = flat().withColumn("class", F.pmod(F.xxhash64("preview"), F.lit(classes)))
    stats = rows.groupBy("display").agg(
        F.count(F.lit(1)).alias("seen"),
        *[F.count_if(F.col("kind") == k).alias(f"kind_{k}") for k in KINDS],
        F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.count("ordinal").alias("_placed"),
        *[F.min(F.when(F.col("class") == c, F.col("ordinal"))).alias(f"_c{c}") for c in range(classes)],
    )
    met = F.array_sort(F.array_compact(F.array(*[F.col(f"_c{c}") for c in range(classes)])))
    stats = stats.withColumn("_until", F.when(F.col("_placed") == F.col("seen"), F.get(met, F.lit(examples - 1)))).drop("_placed", *[f"_c{c}" for c in range(classes)])
    stats = materialize(stats, "paths")  # a row per path: joined by its size
    until = stats.select("display", "_until")
    early = flat().join(until, "display").filter(F.col("_until").isNull() | (F.col("ordinal") <= F.col("_until")))
    pairs = early.groupBy("display", "preview").agg(F.min("ordinal").alias("first"))
    rank = Window.partitionBy("display").orderBy("first", "preview")
    best = pairs.select("display", "preview", F.row_number().over(rank).alias("rn")).filter(F.col("rn") <= examples)
    best = best.groupBy("display").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "preview"))), lambda s: s["preview"]).alias("examples"))
    # Every parsed record has a root.
    valid = stats.filter(F.col("display") == "$").select(F.col("seen").alias("valid"))
    return (
        stats.drop("_until").join(best, "display").join(F.broadcast(valid))
        .withColumn("missing", F.col("valid") - F.col("seen")).withColumn("nulls", F.col("kind_null"))
        .orderBy("display")
    )


def schema_summary(records: DataFrame) -> DataFrame:
    """H2: observed, valid and problem records; complete when every record was observed."""
    return records.agg(
        F.count(F.lit(1)).alias("observed"), F.count("value").alias("valid"), F.count_if(F.col("value").isNull()).alias("problem"),
    ).withColumn("complete", F.lit(True))


def suggest_columns(df: DataFrame, n: int = 12) -> DataFrame:
    """Top-level keys by presence, then name; the root when there is none."""
    top = flatten_paths(df, depth=1).filter((F.col("depth") == 0) | F.try_element_at("path", F.lit(1))["key"].isNotNull())
    seen = top.groupBy("display", "depth").agg(F.count(F.lit(1)).alias("seen"))
    w = Window.partitionBy()
    # One row per distinct top-level key from here on.
    seen = seen.withColumn("_keys", F.max("depth").over(w)).filter(F.col("depth") == F.col("_keys"))
    return seen.select("display", "seen").orderBy(F.col("seen").desc(), "display").limit(n)


def discover_shape(df: DataFrame, depth: int = 4, array_entries: int = 8, top_values: int = 16, max_text: int = 256) -> DataFrame:
    """H3: per path the records holding it, its kinds and its most frequent short strings."""
    flat = flatten_paths(df, depth, array_entries).select("source_id", "ordinal", "display", J.kind(F.col("node")).alias("kind"),
        F.when(J.is_string(F.col("node")) & (F.length(J.as_string(F.col("node"))) <= max_text), J.as_string(F.col("node"))).alias("short"))
    # A path is unique inside one record, so counting rows counts records. Both readers ask
    # for the same columns and filter by an aggregate, so that they share one shuffle.
    pairs = flat.groupBy("display", "kind", "short").agg(F.count(F.lit(1)).alias("n"), F.count("short").alias("strings"))
    shape = pairs.groupBy("display").agg(
        F.sum("n").cast("bigint").alias("records"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.count_if(F.col("strings") > 0).alias("distinct_strings"), F.sum("strings").cast("bigint").alias("_string_rows"),
    )
    shape = shape.select("display", "records", "kinds", "distinct_strings", F.when(F.col("distinct_strings") > 0, F.col("_string_rows")).alias("string_rows"))
    w = Window.partitionBy("display").orderBy(F.col("n").desc(), "short")
    top = pairs.filter(F.col("strings") > 0).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top_values)
    top = top.groupBy("display").agg(F.array_sort(F.collect_list(F.struct("rn", "short", "n"))).alias("top_strings"))
    return shape.join(top, "display", "left")


# How strongly a normalised key names a role in the record.
DISCRIMINATOR_KEYS = {"type": 0.95, "event": 0.95, "eventtype": 0.95, "eventkind": 0.95, "kind": 0.95,
                      "operation": 0.7, "op": 0.7, "state": 0.7, "status": 0.7}
TIME_KEYS = {"timestamp": 0.9, "datetime": 0.9, "time": 0.9, "at": 0.9, "ts": 0.72, "date": 0.72}
ACTOR_KEYS = {"role": 0.9, "actor": 0.9, "author": 0.9, "speaker": 0.9, "sender": 0.9}
TEXT_KEYS = {"text": 0.9, "message": 0.9, "msg": 0.9, "content": 0.9, "body": 0.9,
             "summary": 0.82, "description": 0.82, "display": 0.82, "title": 0.82, "threadname": 0.82}
ID_KEYS = {"id": 0.88, "uuid": 0.88, "sessionid": 0.88, "session": 0.88, "threadid": 0.88, "turnid": 0.88}


def normal_key(key: Column) -> Column:
    return F.lower(F.regexp_replace(key, "[^A-Za-z0-9]", ""))


def _weights(table: dict[str, float], key: Column) -> Column:
    return F.element_at(F.expr("map(" + ", ".join(f"'{k}', {w}D" for k, w in table.items()) + ")"), key)


def key_scores(key: Column, text: Column, is_text: Column) -> dict[str, Column]:
    """Scores of a scalar field in each of the five roles; 0 means not a candidate."""
    zero = F.lit(0.0)
    id_like = (key == "id") | key.endswith("id") | key.contains("path") | key.contains("url")
    timed = key.contains("time") | key.contains("date") | key.endswith("at") | (key == "ts")
    time_value = text.rlike(r"^\d+(\.\d+)?$") | iso_to_ms(text).isNotNull()
    time_tail = key.endswith("timestamp") | key.endswith("time") | key.endswith("at")
    return {
        "discriminator": F.coalesce(_weights(DISCRIMINATOR_KEYS, key), zero),
        "timestamp": F.when(timed & time_value, F.coalesce(_weights(TIME_KEYS, key), F.when(time_tail, 0.72), zero)).otherwise(zero),
        "actor": F.coalesce(_weights(ACTOR_KEYS, key), zero),
        "summary": F.when(~is_text, zero).otherwise(F.coalesce(
            _weights(TEXT_KEYS, key), F.when(id_like, 0.0), F.when(F.length(text) >= 8, 0.28), zero)),
        "identity": F.coalesce(_weights(ID_KEYS, key), F.when(key.endswith("id"), 0.65), zero),
    }


def record_signals(df: DataFrame, depth: int = 4, array_entries: int = 8, identities: int = 6, key: tuple[str, ...] = ("source_id", "ordinal")) -> DataFrame:
    """H5: best discriminator, timestamp, actor and summary of each record, and its identities.

    The best candidate of each role has the highest score, then the shortest path,
    then the first position (paths in key order, since a VARIANT sorts its keys).
    Candidates are rank structs; the identities are the best few of all.
    """
    flat = flatten_paths(df, depth, array_entries, key)
    last = F.try_element_at("path", F.lit(-1))["key"]
    flat = flat.filter((F.col("depth") > 0) & last.isNotNull())
    text = J.scalar_text(F.col("node"))
    flat = J.fence(flat.select(*key, "display", "depth", "node", last.alias("last")), k=normal_key(F.col("last")), text=text, is_text=J.is_string(F.col("node")))
    flat = flat.filter(F.col("text").isNotNull())
    scores = key_scores(F.col("k"), F.col("text"), F.col("is_text"))
    flat = J.fence(flat.select(*key, "display", "depth", "text", "k", "is_text"), **{f"s_{n}": c for n, c in scores.items()})
    aggs = []
    for role in scores:
        rank = F.struct((-F.col(f"s_{role}")).alias("s"), "depth", "display", F.col("text").alias("value"))
        pick = F.when(F.col(f"s_{role}") > 0, rank)
        if role == "identity":
            aggs.append(F.slice(F.array_sort(F.collect_list(pick)), 1, identities).alias("_ids"))
        else:
            aggs.append(F.min(pick).alias(f"_{role}"))
    best = flat.groupBy(*key).agg(*aggs)
    out = [*key]
    for role in ("discriminator", "timestamp", "actor", "summary"):
        out += [F.col(f"_{role}.display").alias(f"{role}_path"), F.col(f"_{role}.value").alias(f"{role}_value")]
    ids = F.transform("_ids", lambda i: F.struct(i["display"].alias("path"), i["value"].alias("value")))
    return best.select(*out, ids.alias("identities"))


def infer_discriminator(shape: DataFrame, total: DataFrame) -> DataFrame:
    """H4: best path by key score + 0.25 coverage + 0.15 repetition, above 0.35."""
    leaf = normal_key(F.regexp_extract("display", r"([A-Za-z0-9_$]+)$", 1))
    score = F.coalesce(_weights(DISCRIMINATOR_KEYS, leaf), F.lit(0.0))
    distinct = F.least(F.col("distinct_strings"), F.lit(16))
    out = shape.filter(F.col("distinct_strings") > 0).join(F.broadcast(total))  # one-row total
    repetition = F.when((distinct == 1) & (F.col("total") > 1), 0.4).otherwise(F.least(F.lit(1.0), distinct / 4))
    out = out.select("display", F.round(score + 0.25 * F.col("records") / F.col("total") + 0.15 * repetition, 6).alias("score"),
                     F.size(F.split("display", r"[.\[]")).alias("depth"))
    named = out.filter((F.col("score") > 0.35) & ~F.col("display").endswith("]"))
    return named.orderBy(F.col("score").desc(), "depth", "display").limit(1).select("display", "score")


def path_tree(stats: DataFrame) -> DataFrame:
    """H6: parent and child listing of observed paths; array entries share one group."""
    shown = F.regexp_replace("display", r"\[\d+\]", "[]")
    groups = stats.groupBy(shown.alias("path")).agg(F.sum("seen").cast("bigint").alias("seen"))
    # The parent is the path without its last step.
    parent = F.when(F.col("path") == "$", None).otherwise(F.regexp_replace("path", r"(\.[A-Za-z_$][A-Za-z0-9_$]*|\[\"(?:[^\"\\]|\\.)*\"\]|\[\])$", ""))
    nodes = groups.withColumn("parent", parent)
    kids = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("children"))
    return nodes.join(kids, "path", "left").select("path", "parent", "seen", F.coalesce("children", F.lit(0)).cast("bigint").alias("children"))


def row_type_values(df: DataFrame, events: DataFrame | None = None, max_text: int = 128) -> DataFrame:
    """H7: distinct short top-level string types, together with observed event kinds."""
    t = J.string_at(F.col("value"), "type")
    out = df.select(t.alias("row_type")).filter(F.length("row_type") <= max_text).distinct().withColumn("origin", F.lit("type"))
    if events is not None:
        out = out.unionByName(events.select(F.col("event_kind").alias("row_type")).distinct().withColumn("origin", F.lit("event_kind")))
    return out
