"""Session catalog and collections as tables.

entities(source_id, native_id, kind, label, vendor_title, preview, started_ms,
activity_ms, parent_native_id, seq), relations(source_id, from_id, to_id, kind),
locations(source_id, native_id, path, ordinal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY = ["source_id", "native_id"]

# Openings of messages that a tool, not a person, wrote.
INJECTED = r"^\s*(?:# AGENTS\.md instructions|<environment_context>|<permissions instructions>|<local-command|<command-name>|<system-reminder>)"


def user_preview(text: Column, max_chars: int = 240) -> Column:
    """One line of a message a user wrote; injected messages give NULL."""
    flat = F.trim(F.regexp_replace(text, r"[\s\x00-\x1f\x7f]+", " "))
    return F.when(~text.rlike(INJECTED) & (F.length(flat) > 0), F.substring(flat, 1, max_chars))


def normalize_id(text: Column) -> Column:
    """A safe id as it is, any other as a digest."""
    return F.when(text.rlike(r"^[A-Za-z0-9._:-]{1,256}\z"), text).otherwise(F.concat(F.lit("id-"), F.substring(F.sha2(text, 256), 1, 32)))


def sessions(events: DataFrame) -> DataFrame:
    """One entity per session: first user text, start, last activity, records.

    A map-side combined aggregate; min_by keeps one candidate per group, so even a
    session holding a third of all rows costs one row per task.
    """
    preview = F.when(F.col("actor") == "user", user_preview(F.col("summary")))
    ms = F.unix_millis("ts")
    return events.filter(F.col("session_id").isNotNull()).groupBy("source_id", F.col("session_id").alias("native_id")).agg(
        F.min_by(preview, F.when(preview.isNotNull(), F.col("ordinal"))).alias("preview"), F.min(ms).alias("started_ms"), F.max(ms).alias("activity_ms"),
        F.count(F.lit(1)).alias("records"), F.min("ordinal").alias("first_ordinal"))


# Words in type names that decide an entity's kind; the first that occurs counts.
KIND_WORDS = [
    ("session", "session"), ("thread", "thread"), ("fork", "other"), ("subagent", "subagent"), ("agent", "subagent"), ("workflow", "workflow"), ("team", "team"), ("tool", "tool"), ("call", "tool"),
    ("goal", "goal"), ("plan", "plan"), ("memory", "memory"), ("task", "task"), ("event", "event"), ("message", "event"), ("response", "event"),
]


def entity_kind(type_name: Column) -> Column:
    """Kind of an entity from its type name."""
    low = F.lower(type_name)
    return F.coalesce(*[F.when(low.contains(w), F.lit(k)) for w, k in KIND_WORDS], F.lit("other"))


def first_wins(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The row with the lowest order per key; a minimum per key, joined back, sorts no group."""
    best = df.groupBy(*keys).agg(F.min(order).alias(order))
    return df.join(best, [*keys, order], "left_semi")


def append_snapshot(old: DataFrame, page: DataFrame, keys: list[str]) -> DataFrame:
    """C4: old rows overridden by page rows."""
    return old.join(page.select(*keys), keys, "left_anti").unionByName(page)


def union_relations(old: DataFrame, page: DataFrame) -> DataFrame:
    """C4: relations of both, without repeats."""
    return old.unionByName(page).dropDuplicates(["source_id", "from_id", "to_id", "kind"])


def replace_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources present in the new snapshot are swapped whole; others stay."""
    return old.join(new.select("source_id").distinct(), "source_id", "left_anti").unionByName(new)


def guarded(current: DataFrame, expected: DataFrame) -> DataFrame:
    """Sources whose generation or fingerprint is not the expected one; empty means the write may go on."""
    j = expected.select("source_id", F.col("generation").alias("want_generation"), F.col("fingerprint").alias("want_fingerprint")).join(current, "source_id", "left")
    bad = ~(F.col("generation").eqNullSafe(F.col("want_generation")) & F.col("fingerprint").eqNullSafe(F.col("want_fingerprint")))
    return j.filter(bad).select("source_id", F.when(F.col("generation").eqNullSafe(F.col("want_generation")), "fingerprint-changed").otherwise("generation-changed").alias("reason"))


def fingerprints(files: DataFrame) -> DataFrame:
    """Digest per source over path, size and time of its files.

    Each file is hashed on its own and the hashes are summed, so the order does not
    matter and no source gathers its file list in one task.
    """
    h = F.sha2(F.concat_ws("|", "path", F.col("size_bytes").cast("string"), F.col("mtime").cast("string")), 256)
    pieces = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    sums = files.groupBy("source_id").agg(F.count(F.lit(1)).alias("files"), *pieces)
    return sums.select("source_id", "files", F.sha2(F.concat_ws("|", F.col("files").cast("string"), *[F.col(f"p{i}").cast("string") for i in range(4)]), 256).alias("fingerprint"))


def source_id(provider: Column, uri: Column) -> Column:
    """Provider and a digest prefix of the canonical location."""
    return F.concat(provider, F.lit("-"), F.substring(F.sha2(F.lower(F.regexp_replace(uri, "/+$", "")), 256), 1, 16))


def expire(df: DataFrame, configured: DataFrame) -> DataFrame:
    """C11: rows of sources still configured."""
    return df.join(configured.select("source_id").distinct(), "source_id", "left_semi")


def stale_sources(stored: DataFrame, probed: DataFrame) -> DataFrame:
    """Sources whose stored and newly probed fingerprints differ."""
    j = stored.select("source_id", F.col("fingerprint").alias("old")).join(probed.select("source_id", F.col("fingerprint").alias("new")), "source_id", "full_outer")
    return j.filter(~F.col("old").eqNullSafe(F.col("new"))).select("source_id")


def reconcile_parents(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """A parent from a `parent` relation (child to parent) when that parent exists."""
    rel = first_wins(relations.filter(F.col("kind") == "parent").withColumn("seq", F.col("to_id")), ["source_id", "from_id"])
    known = entities.select("source_id", F.col("native_id").alias("to_id"))
    good = rel.join(known, ["source_id", "to_id"], "left_semi").select("source_id", F.col("from_id").alias("native_id"), F.col("to_id").alias("_parent"))
    out = entities.join(good, ENTITY, "left")
    return out.withColumn("relationship", F.when(F.col("_parent").isNotNull(), "subagent").otherwise("root")).withColumn(
        "parent_native_id", F.coalesce("_parent", "parent_native_id")).drop("_parent")


def orphans(entities: DataFrame) -> DataFrame:
    """Entities whose declared parent is absent."""
    have = entities.select("source_id", F.col("native_id").alias("parent_native_id"))
    return entities.filter(F.col("parent_native_id").isNotNull()).join(have, ["source_id", "parent_native_id"], "left_anti")


def fork_edges(forks: DataFrame) -> DataFrame:
    """(path, native_id, parent_path) -> fork edges by normalised path."""
    def norm(c: str) -> Column:
        return F.lower(F.regexp_replace(F.regexp_replace(F.col(c), r"\\", "/"), "/+", "/"))
    owners = forks.select(norm("path").alias("p"), F.col("native_id").alias("to_id"))
    return forks.filter(F.col("parent_path").isNotNull()).select(norm("parent_path").alias("p"), F.col("native_id").alias("from_id")).join(owners, "p").select(
        "from_id", "to_id", F.lit("fork").alias("kind"))


def titled(entities: DataFrame, overrides: DataFrame) -> DataFrame:
    """Shown title: own title, then the vendor's, then the label."""
    return entities.join(overrides.select(*ENTITY, "title"), ENTITY, "left").withColumn("title", F.coalesce("title", "vendor_title", "label"))


def override_titles(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert titles; a NULL title clears one."""
    kept = current.join(changes.select(*ENTITY), ENTITY, "left_anti")
    return kept.unionByName(changes.filter(F.col("title").isNotNull()))


# Relation kinds an input may use.
RELATION_KINDS = ["parent", "child", "fork", "spawn", "contains", "uses"]


def relation_inputs(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, native_id, links ARRAY<STRUCT<kind,id>>) -> relations with both ends present; child turns into parent."""
    links = rows.select("source_id", F.col("native_id").alias("a"), F.explode("links").alias("l")).filter(F.col("l.kind").isin(RELATION_KINDS))
    swap = F.col("l.kind") == "child"
    out = links.select("source_id", F.when(swap, F.col("l.id")).otherwise(F.col("a")).alias("from_id"), F.when(swap, F.col("a")).otherwise(F.col("l.id")).alias("to_id"),
                       F.when(swap, "parent").otherwise(F.col("l.kind")).alias("kind"))
    ids = entities.select("source_id", "native_id").distinct()
    out = out.join(ids.withColumnRenamed("native_id", "from_id"), ["source_id", "from_id"], "left_semi")
    return out.join(ids.withColumnRenamed("native_id", "to_id"), ["source_id", "to_id"], "left_semi").select("source_id", "from_id", "to_id", "kind").distinct()


# Entity types an input row may have.
INPUT_TYPES = ["session", "thread", "turn", "workflow", "team", "tool", "goal", "plan", "memory", "task", "subagent", "event"]
CONTROL = r"[\x00-\x1f\x7f]"


def checked_rows(rows: DataFrame) -> DataFrame:
    """A reject code per row of (type, id, label, parent_id, updated_at, status, confidence), NULL when accepted.

    The first fault counts, in this order; a missing type counts as a missing id, and
    absent optional fields are fine.
    """
    def bad(name: str, most: int, extra: str | None = None) -> Column:
        c = F.col(name)
        fault = (F.length(c) > most) | c.rlike(CONTROL)
        return c.isNotNull() & (fault | c.rlike(extra) if extra else fault)
    safe_id = r"^[A-Za-z0-9._:-]{1,256}\z"
    code = (
        F.when(F.col("type").isNull(), "missing_id").when(~F.col("type").isin(INPUT_TYPES), "unsupported_type")
        .when(F.col("id").isNull() | (F.col("id") == ""), "missing_id").when(~F.col("id").rlike(safe_id), "invalid_id")
        .when((F.col("label") == "") | bad("label", 256, r"^(?:[A-Za-z]:[\\/]|[\\/]{1,2}|file://)"), "invalid_label")
        .when(F.col("parent_id").isNotNull() & ~F.col("parent_id").rlike(safe_id), "invalid_parent")
        .when((F.col("updated_at") == "") | bad("updated_at", 64), "invalid_timestamp")
        .when(bad("status", 128), "invalid_status")
        .when(F.col("confidence").isNotNull() & ~F.col("confidence").isin("source", "correlated", "inferred"), "invalid_confidence"))
    return rows.withColumn("reject", code)


def source_totals(entities: DataFrame) -> DataFrame:
    """Entities and last activity per source."""
    return entities.groupBy("source_id").agg(F.count(F.lit(1)).alias("entities"), F.max(F.coalesce("activity_ms", "started_ms")).alias("last_activity_ms"))


def children_page(entities: DataFrame, parent: Column, order: str = "activity", limit: int = 50, after: tuple | None = None) -> DataFrame:
    """One page of children by activity, creation (both newest first) or shown title, ties by id.

    Times fall back (activity, update, start; or start, update) and sort last where all
    are absent; titles compare without ASCII case. `sort_value` and `native_id` of the
    last row are the next page's `after`; `has_more` tells whether there is one.
    """
    have = set(entities.columns)
    times = {"activity": ["activity_ms", "updated_ms", "started_ms"], "created": ["started_ms", "updated_ms"]}
    if order == "title":
        shown = F.coalesce(*[F.col(c) for c in ("title", "vendor_title", "label") if c in have])
        key = F.translate(shown, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    else:
        key = F.coalesce(*[F.col(c) for c in times[order] if c in have], F.lit(-(1 << 63)))
    kids = entities.filter(parent).withColumn("sort_value", key)
    if after is not None:
        last = F.lit(after[0])
        beyond = F.col("sort_value") > last if order == "title" else F.col("sort_value") < last
        kids = kids.filter(beyond | ((F.col("sort_value") == last) & (F.col("native_id") > F.lit(after[1]))))
    ordering = [F.col("sort_value").asc() if order == "title" else F.col("sort_value").desc(), F.col("native_id").asc()]
    probe = kids.orderBy(*ordering).limit(limit + 1).withColumn("_n", F.row_number().over(Window.orderBy(*ordering)))
    return probe.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).filter(F.col("_n") <= limit).drop("_n")


def with_children(entities: DataFrame) -> DataFrame:
    """Entities that have children."""
    return entities.join(entities.select("source_id", F.col("parent_native_id").alias("native_id")), ENTITY, "left_semi")


def search(entities: DataFrame, relations: DataFrame, kind: str | None = None, parent: str | None = None, text: str | None = None, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page of matching entities, and every relation touching one of them at either end."""
    hit = entities
    if kind:
        hit = hit.filter(F.col("kind") == kind)
    if parent:
        hit = hit.filter(F.col("parent_native_id") == parent)
    if text:
        hit = hit.filter(F.lower("label").contains(text.lower()))
    page = hit.orderBy(*ENTITY).offset(offset).limit(limit)
    ids = page.select("source_id", "native_id")
    left = relations.join(ids.withColumnRenamed("native_id", "from_id"), ["source_id", "from_id"], "left_semi")
    right = relations.join(ids.withColumnRenamed("native_id", "to_id"), ["source_id", "to_id"], "left_semi")
    return page, left.unionByName(right).distinct()


def locate(entities: DataFrame, locations: DataFrame, records: DataFrame) -> DataFrame:
    """C14: file and ordinal of each entity in the current generation."""
    return entities.join(locations, ENTITY).join(records.select("source_id", "ordinal", "generation"), ["source_id", "ordinal"])


def thread_entities(threads: DataFrame, titles: DataFrame, spawns: DataFrame) -> DataFrame:
    """Threads with their titles and spawning parents: name, index title, agent name, then row title."""
    out = threads.join(titles.select("thread_id", "index_title"), "thread_id", "left").join(spawns.select(F.col("child_id").alias("thread_id"), "parent_id"), "thread_id", "left")
    return out.withColumn("title", F.coalesce("name", "index_title", "agent", "row_title")).withColumn("status", F.when(F.col("archived"), "archived").otherwise("active"))


# ---- collections -------------------------------------------------------------------


def fold_commands(log: DataFrame) -> dict[str, DataFrame]:
    """The collections, members and entry states after a command log.

    log(request_id, revision, op, collection_id, entry_id, text). A request counts
    once, by its lowest revision. A collection lives from its first creation after its
    last deletion; renaming, adding and removing count only after that, the last
    revision deciding. What names a deleted or unknown collection is refused.
    """
    once = first_wins(log, ["request_id"], "revision")
    def last(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(F.max_by("op", "revision").alias("op"), F.max_by("text", "revision").alias("text"), F.max("revision").alias("revision"))
    deleted = once.filter(F.col("op") == "delete").groupBy("collection_id").agg(F.max("revision").alias("deleted_at"))
    created = once.filter(F.col("op") == "create").join(deleted, "collection_id", "left").filter(F.col("deleted_at").isNull() | (F.col("revision") > F.col("deleted_at")))
    created = created.groupBy("collection_id").agg(F.min("revision").alias("created_at"))
    since = once.join(created, "collection_id")
    named = (F.col("op") == "create") & (F.col("revision") == F.col("created_at")) | (F.col("op") == "rename") & (F.col("revision") > F.col("created_at"))
    live = last(since.filter(named), ["collection_id"]).select("collection_id", F.col("text").alias("name"))
    member = since.filter(F.col("op").isin("add", "remove") & (F.col("revision") > F.col("created_at")))
    member = last(member, ["collection_id", "entry_id"]).filter(F.col("op") == "add").select("collection_id", "entry_id")
    alias = last(once.filter(F.col("op") == "alias"), ["entry_id"]).select("entry_id", F.col("text").alias("alias"))
    archived = last(once.filter(F.col("op").isin("archive", "restore")), ["entry_id"]).select("entry_id", (F.col("op") == "archive").alias("archived"))
    entries = once.filter(F.col("entry_id").isNotNull()).select("entry_id").distinct().join(alias, "entry_id", "left").join(archived, "entry_id", "left")
    return {"collections": live, "members": member, "entries": entries.withColumn("archived", F.coalesce("archived", F.lit(False)))}


def collection_counts(folded: dict[str, DataFrame]) -> DataFrame:
    """Entries per collection, empty ones included."""
    n = folded["members"].groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
    return folded["collections"].join(n, "collection_id", "left").select("collection_id", "name", F.coalesce("n", F.lit(0)).alias("entries"))


def archived_members(folded: dict[str, DataFrame]) -> DataFrame:
    """Archived entries that any collection holds."""
    return folded["entries"].filter("archived").join(folded["members"].select("entry_id"), "entry_id", "left_semi").select("entry_id")
