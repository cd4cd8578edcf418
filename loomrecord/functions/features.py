"""Fields found by the meaning of their key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J


@dataclass(frozen=True)
class Feature:
    """A meaning: keys that carry it (case and punctuation don't matter), its weight, and the kinds of value it accepts (all, if empty)."""

    id: str
    keys: tuple[str, ...]
    weight: float = 1.0
    kinds: tuple[str, ...] = ()


def _plain(key: str) -> str:
    return "".join(c for c in key if c.isascii() and c.isalnum()).lower()


def nodes(df: DataFrame, value: str, depth: int) -> DataFrame:
    """Adds `nodes`, all values below `value` down to `depth` steps, with their paths: ARRAY<STRUCT<path, node>>.

    Each level is one column made from the level above it, inside the row.
    """
    step = "struct<key:string,idx:int>"
    below = (
        f"concat(coalesce(transform(map_entries(try_variant_get(n.node, '$', 'map<string,variant>')), e -> named_struct('path', concat(n.path, array(cast(named_struct('key', e.key, 'idx', null) AS {step}))), 'node', e.value)), array()), "
        f"coalesce(transform(try_variant_get(n.node, '$', 'array<variant>'), (x, i) -> named_struct('path', concat(n.path, array(cast(named_struct('key', null, 'idx', i) AS {step}))), 'node', x)), array()))")
    df = J.fence(df, level0=F.expr(f"array(named_struct('path', cast(array() AS array<{step}>), 'node', {value}))"))
    for d in range(depth):
        df = J.fence(df, **{f"level{d + 1}": F.expr(f"flatten(transform(level{d}, n -> {below}))")})
    levels = [f"level{d}" for d in range(1, depth + 1)]
    return df.withColumn("nodes", F.concat(*levels)).drop("level0", *levels)


def semantic_features(records: DataFrame, vocabulary: list[Feature], depth: int = 7, most: int | None = None, key: tuple[str, ...] = ("source_id", "ordinal")) -> DataFrame:
    """(key, rank, feature, key_name, path, score, value): the fields whose key means a feature, best first in each record.

    The score is the weight, plus 0.2 for a text that is not blank, 0.08 for a list with
    entries or 0.04 for another container, less 0.05 for each step below the first. Ties
    go to the shorter path, then to its text. `most` keeps that many of each record. Nothing is
    shuffled: a record is walked, matched and ranked inside its row.
    """
    wanted = [(k, f.id, f.weight, f.kinds) for f in vocabulary for k in dict.fromkeys(_plain(k) for k in f.keys) if k]
    if not wanted:
        raise ValueError("a vocabulary needs keys")
    table = "array(" + ", ".join(f"named_struct('k', {J.sql_text(k)}, 'id', {J.sql_text(i)}, 'weight', {float(w)}D, 'kinds', array({', '.join(J.sql_text(x) for x in kinds)}))" for k, i, w, kinds in wanted) + ")"
    kind = "CASE WHEN s LIKE 'OBJECT%' THEN 'object' WHEN s LIKE 'ARRAY%' THEN 'array' WHEN s = 'STRING' THEN 'string' WHEN s = 'BOOLEAN' THEN 'boolean' WHEN s = 'VOID' THEN 'null' ELSE 'number' END"
    kept = "filter(nodes, n -> array_contains(words, lower(regexp_replace(element_at(n.path, -1).key, '[^A-Za-z0-9]', ''))))"
    df = nodes(records.filter(F.col("value").isNotNull()).select(*key, "value"), "value", depth)
    df = df.withColumn("words", F.array(*[F.lit(k) for k in dict.fromkeys(w[0] for w in wanted)]))
    df = J.fence(df, found=F.expr(f"transform({kept}, n -> named_struct('path', n.path, 'node', n.node, 'name', element_at(n.path, -1).key, 'kind', {J.bind_sql('schema_of_variant(n.node)', 's', kind)}))")).drop("nodes", "words")
    bonus = "CASE WHEN n.kind = 'string' AND try_variant_get(n.node, '$', 'string') rlike '\\\\S' THEN 0.2D WHEN n.kind = 'array' AND size(try_variant_get(n.node, '$', 'array<variant>')) > 0 THEN 0.08D WHEN n.kind IN ('object', 'array') THEN 0.04D ELSE 0D END"
    fits = f"filter({table}, f -> f.k = lower(regexp_replace(n.name, '[^A-Za-z0-9]', '')) AND (size(f.kinds) = 0 OR array_contains(f.kinds, n.kind)))"
    text = "array_join(transform(n.path, t -> if(t.key IS NULL, concat('index:', t.idx), concat('key:', t.key))), '/')"
    scored = (f"flatten(transform(found, n -> transform({fits}, f -> named_struct('less', -round(greatest(0D, f.weight + {bonus} - greatest(0, size(n.path) - 1) * 0.05D), 6), 'steps', size(n.path), 'text', {text}, 'feature', f.id, "
              "'name', n.name, 'path', n.path, 'node', n.node))))")
    # Sorted by the first four fields, which tell all apart; a VARIANT has no order.
    order = ("array_sort({0}, (a, b) -> CASE WHEN a.less != b.less THEN if(a.less < b.less, -1, 1) WHEN a.steps != b.steps THEN if(a.steps < b.steps, -1, 1) WHEN a.text != b.text THEN if(a.text < b.text, -1, 1) "
             "WHEN a.feature != b.feature THEN if(a.feature < b.feature, -1, 1) ELSE 0 END)")
    ranked = J.fence(df, scored=F.expr(scored))
    ranked = J.fence(ranked, best=F.expr(order.format("scored") if most is None else f"slice({order.format('scored')}, 1, {int(most)})"))
    out = ranked.select(*key, F.posexplode("best").alias("pos", "b"))
    return out.select(*key, (F.col("pos") + 1).alias("rank"), "b.feature", F.col("b.name").alias("key_name"), J.display_path(F.col("b.path")).alias("path"), (-F.col("b.less")).alias("score"), F.col("b.node").alias("value"))
