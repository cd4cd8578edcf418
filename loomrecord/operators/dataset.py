"""Structural observations over training-data records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J

# Inspected fields.
MESSAGE_FIELDS = ["messages", "conversations", "chosen_messages", "rejected_messages"]
TOKEN_FIELDS = ["tokens", "input_ids", "labels", "attention_mask"]
COUNT_FIELDS = ["token_count", "num_tokens"]
CATEGORY_FIELDS = ["label", "category", "split", "language"]
MEDIA_TYPES = {"image": ["image", "image_url", "input_image"], "audio": ["audio", "audio_url", "input_audio"], "video": ["video", "video_url", "input_video"]}


@dataclass(frozen=True)
class Limits:
    """Optional bounds on what a record's observation looks at; None, the default, looks at all of it."""

    messages: int | None = None
    blocks: int | None = None
    tokens: int | None = None
    category_chars: int | None = None


def _head(array: str, n: int | None) -> str:
    return array if n is None else f"slice({array}, 1, {n})"


def _over(size: str, n: int | None) -> str:
    return "false" if n is None else f"{size} > {n}"


ROLES = ["user", "assistant", "system", "tool", "function", "unknown"]


def _array(value: str, key: str) -> str:
    return f"try_variant_get({value}, '$.{key}', 'array<variant>')"


def _has(key: str) -> str:
    return f"({J.get_sql('value', key)} IS NOT NULL)"


def _any(keys: list[str]) -> str:
    return "(" + " OR ".join(_has(k) for k in keys) + ")"


def _first(value: str, *keys: str) -> str:
    """a ?? b ?? c: the last one keeps a JSON null."""
    return "coalesce(" + ", ".join([*[J.nonnull_sql(value, k) for k in keys[:-1]], J.get_sql(value, keys[-1])]) + ")"


def _message_facts(limits: Limits) -> str:
    """ARRAY of facts about the observed messages of all message fields, in field order."""
    table = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in J.ROLE_NAMES.items()) + ")"
    speaker = _first("m", "role", "from", "speaker")
    role = J.bind_sql(speaker, "sp", f"coalesce({table}[lower(if(schema_of_variant(sp) = 'STRING', try_variant_get(sp, '$', 'string'), null))], 'unknown')")
    content = _first("m", "content", "value", "text")
    weight = J.get_sql("m", "loss_weight")
    number = f"try_variant_get({weight}, '$', 'double')"
    loss = (f"CASE WHEN {weight} IS NULL THEN null WHEN schema_of_variant({weight}) LIKE 'ARRAY%' THEN 'array' WHEN NOT schema_of_variant({weight}) rlike '^(BIGINT|DOUBLE|DECIMAL)' "
            f"THEN 'invalid' WHEN {number} = 0 THEN 'zero' WHEN {number} > 0 THEN 'positive' ELSE 'negative' END")
    blocks = f"transform({_head(f"coalesce(try_variant_get({content}, '$', 'array<variant>'), array())", limits.blocks)}, b -> if(schema_of_variant({J.get_sql('b', 'type')}) = 'STRING', try_variant_get(b, '$.type', 'string'), null))"
    fact = (f"if(schema_of_variant(m) LIKE 'OBJECT%', named_struct('role', {role}, 'state', {J.bind_sql(content, 'ct', J.content_state_sql('ct'))}, 'loss', {loss}, 'blocks', {blocks}, "
            f"""'cut', {_over(f"size(coalesce(try_variant_get({content}, '$', 'array<variant>'), array()))", limits.blocks)}), null)""")
    every = ", ".join(f"coalesce({_array('value', f)}, array())" for f in MESSAGE_FIELDS)
    return f"transform({_head(f'concat({every})', limits.messages)}, m -> {fact})"


def _sequence(field: str, limits: Limits) -> str:
    a = _array("value", field)
    safe = "(schema_of_variant(t) = 'BIGINT' AND abs(try_variant_get(t, '$', 'double')) <= 9007199254740991D OR schema_of_variant(t) rlike '^(DECIMAL|DOUBLE)' AND try_variant_get(t, '$', 'double') % 1 = 0)"
    text_ok = " AND NOT schema_of_variant(t) = 'STRING'" if field == "tokens" else ""
    head = _head(a, limits.tokens)
    return (f"if({a} IS NULL, null, named_struct('field', '{field}', 'length', size({a}), 'non_integer', size(filter({head}, t -> NOT {safe})), "
            f"'negative100', size(filter({head}, t -> {safe} AND try_variant_get(t, '$', 'double') = -100)), 'invalid', size(filter({head}, t -> NOT {safe}{text_ok})), 'cut', {_over(f'size({a})', limits.tokens)}))")


def _declared(field: str) -> str:
    g = J.get_sql("value", field)
    n = f"try_variant_get({g}, '$', 'double')"
    ok = f"schema_of_variant({g}) rlike '^(BIGINT|DOUBLE|DECIMAL)' AND {n} >= 0 AND {n} % 1 = 0 AND {n} <= 9007199254740991D"
    return f"if({g} IS NULL, null, named_struct('field', '{field}', 'value', if({ok}, cast({n} AS bigint), null)))"


def _media(kind: str, field: str) -> str:
    types = ", ".join(f"'{t}'" for t in MEDIA_TYPES[kind])
    blocks = f"aggregate(_msg, 0, (n, m) -> n + size(filter(coalesce(m.blocks, array()), t -> t IN ({types}))))"
    refs = f"CASE WHEN {_array('value', field)} IS NOT NULL THEN size({_array('value', field)}) WHEN {J.string_sql('value', field)} IS NOT NULL THEN 1 ELSE 0 END"
    return f"{blocks} + {refs}"


def _category(field: str, limits: Limits) -> str:
    g = J.get_sql("value", field)
    text = f"try_variant_get({g}, '$', 'string')"
    return (f"CASE WHEN schema_of_variant({g}) = 'STRING' THEN if({_over(f'length({text})', limits.category_chars)}, null, named_struct('field', '{field}', 'value', {text})) "
            f"WHEN schema_of_variant({g}) = 'BOOLEAN' OR schema_of_variant({g}) rlike '^(BIGINT|DOUBLE|DECIMAL)' THEN named_struct('field', '{field}', 'value', regexp_replace({text}, '[.]0$', '')) END")


def _scene(limits: Limits) -> str:
    """A10: the first matching scene, with the state of its target."""
    def state(*keys: str) -> str:
        return J.bind_sql(_first("value", *keys), "t0", J.content_state_sql("t0"))
    chosen, rejected = state("chosen", "chosen_messages"), state("rejected", "rejected_messages")
    pair = J.bind_sql(f"array({chosen}, {rejected})", "pr", "CASE WHEN array_contains(pr, 'missing') THEN 'missing' WHEN array_contains(pr, 'empty') THEN 'empty' ELSE 'present' END")
    talk = ("CASE WHEN exists(_msg, m -> m.role = 'assistant' AND m.state = 'present') THEN 'present' WHEN " + _over("_total", limits.messages) +
            " THEN 'unknown' WHEN exists(_msg, m -> m.role = 'assistant' AND m.state = 'empty') THEN 'empty' ELSE 'missing' END")
    is_talk = "(" + " OR ".join(f"{_array('value', f)} IS NOT NULL" for f in MESSAGE_FIELDS) + ")"
    text = " OR ".join(f"schema_of_variant({J.get_sql('value', k)}) = 'STRING'" for k in ("text", "content"))
    rows = [
        (_any(["chosen", "rejected", "chosen_messages", "rejected_messages"]), "preference", pair), (is_talk, "conversation", talk),
        (_any(["instruction", "prompt"]), "instruction", state("output", "response", "completion")),
        (_any(["question", "answer"]), "qa", state("answer")),
        (f"{_has('label')} AND {_any(['text', 'content', 'input'])}", "classification", state("label")),
        ("size(_seq) > 0", "tokenized", "'not-applicable'"), (f"({text})", "pretraining", "'not-applicable'"),
    ]
    cases = " ".join(f"WHEN {test} THEN named_struct('scene', '{scene}', 'target', {target})" for test, scene, target in rows)
    return f"CASE {cases} ELSE named_struct('scene', 'unknown', 'target', 'unknown') END"


def record_summary(records: DataFrame, key: tuple[str, ...] = ("source_id", "ordinal"), limits: Limits = Limits()) -> DataFrame:
    """One flat observation per record, of all of it unless `limits` says less. Column expressions only; no shuffle."""
    total = " + ".join(f"coalesce(size({_array('value', f)}), 0)" for f in MESSAGE_FIELDS)
    df = J.fence(
        records, _valid=J.is_object(F.col("value")), _msg=F.expr(_message_facts(limits)), _total=F.expr(total),
        _seq=F.expr("filter(array(" + ", ".join(_sequence(f, limits) for f in TOKEN_FIELDS) + "), s -> s IS NOT NULL)"),
        _dec=F.expr("filter(array(" + ", ".join(_declared(f) for f in COUNT_FIELDS) + "), d -> d IS NOT NULL)"),
        _cat=F.expr("filter(array(" + ", ".join(_category(f, limits) for f in CATEGORY_FIELDS) + "), c -> c IS NOT NULL)"),
        _long=F.expr(" OR ".join(f"coalesce({_over('length(' + J.string_sql('value', f) + ')', limits.category_chars)}, false)" for f in CATEGORY_FIELDS)))
    df = J.fence(df, _sc=F.expr(_scene(limits)))
    cut = F.expr(f"{_over('_total', limits.messages)} OR exists(_msg, m -> m.cut) OR exists(_seq, s -> s.cut) OR _long")
    mismatch = F.expr("exists(_dec, d -> d.value IS NOT NULL AND exists(_seq, s -> s.field IN ('tokens', 'input_ids') AND s.length != d.value))")
    aligned = F.expr("exists(_seq, i -> i.field = 'input_ids' AND exists(_seq, s -> s.field IN ('labels', 'attention_mask') AND s.length != i.length))")
    issues = {
        "unknown-scene": F.col("_sc.scene") == "unknown", "missing-target": F.col("_sc.target") == "missing", "empty-target": F.col("_sc.target") == "empty",
        "incomplete-preference": (F.col("_sc.scene") == "preference") & (F.col("_sc.target") != "present"),
        "invalid-message": F.expr("exists(_msg, m -> m IS NULL)"), "unknown-role": F.expr("exists(_msg, m -> m.role = 'unknown')"),
        "invalid-loss-weight": F.expr("exists(_msg, m -> m.loss = 'invalid')"), "invalid-token-id": F.expr("exists(_seq, s -> s.invalid > 0)"),
        "invalid-declared-count": F.expr("exists(_dec, d -> d.value IS NULL)"), "token-count-mismatch": mismatch, "token-length-mismatch": aligned,
        "inspection-truncated": cut,
    }
    found = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in issues.items()])
    listed = F.when(F.col("_valid"), F.array_compact(found)).otherwise(F.array(F.lit("invalid-record")))
    losses = ["zero", "positive", "negative", "invalid", "array"]
    return df.select(
        *key, F.col("_valid").alias("valid"), F.when(F.col("_valid"), F.col("_sc.scene")).otherwise("unknown").alias("scene"),
        F.when(F.col("_valid"), F.col("_sc.target")).otherwise("unknown").alias("target"),
        F.col("_total").cast("bigint").alias("messages"), F.size("_msg").cast("bigint").alias("observed"),
        *[F.expr(f"cast(size(filter(_msg, m -> m.role = '{r}')) AS bigint)").alias(f"role_{r}") for r in ROLES],
        *[F.expr(f"cast(size(filter(_msg, m -> m.loss = '{x}')) AS bigint)").alias(f"loss_{x}") for x in losses],
        F.col("_seq").alias("sequences"), F.filter("_dec", lambda d: d["value"].isNotNull()).alias("declared"),
        *[F.expr(f"cast({_media(k, k + 's')} AS bigint)").alias(f"media_{k}") for k in MEDIA_TYPES],
        F.when(F.col("_valid"), F.col("_cat")).alias("categories"), listed.alias("issues"), F.coalesce(cut, F.lit(False)).alias("truncated"))


def totals(summaries: DataFrame) -> DataFrame:
    """One row of sums over all records."""
    sums = [c for c in summaries.columns if c.startswith(("role_", "loss_", "media_")) or c in ("messages", "observed")]
    return summaries.agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"),
                         *[F.sum(c).cast("bigint").alias(c) for c in sums], F.count_if("truncated").alias("truncated"))


def counts(summaries: DataFrame) -> DataFrame:
    """Records per scene, target and issue in one pass: (dimension, value, records)."""
    tags = F.concat(F.array(F.struct(F.lit("scene").alias("dimension"), F.col("scene").alias("value")), F.struct(F.lit("target").alias("dimension"), F.col("target").alias("value"))),
                    F.transform("issues", lambda i: F.struct(F.lit("issue").alias("dimension"), i.alias("value"))))
    return summaries.select(F.explode(tags).alias("t")).groupBy("t.dimension", "t.value").agg(F.count(F.lit(1)).alias("records"))


def lengths(summaries: DataFrame) -> DataFrame:
    """Count, least, greatest and mean length per token field and declared count."""
    seq = F.transform("sequences", lambda s: F.struct(s["field"].alias("field"), s["length"].cast("bigint").alias("n")))
    dec = F.transform("declared", lambda d: F.struct(d["field"].alias("field"), d["value"].alias("n")))
    return summaries.select(F.explode(F.concat(seq, dec)).alias("s")).groupBy("s.field").agg(
        F.count(F.lit(1)).alias("records"), F.min("s.n").alias("min"), F.max("s.n").alias("max"), F.round(F.avg("s.n"), 6).alias("mean"))


def categories(summaries: DataFrame, limit: int | None = 32, field: str = "categories") -> DataFrame:
    """The first-seen values of each category field; the rest is folded into one NULL row (None folds nothing)."""
    rows = summaries.select(*[k for k in ("source_id", "ordinal") if k in summaries.columns], F.explode(field).alias("c")).groupBy("c.field", "c.value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("source_id", "ordinal") if "source_id" in summaries.columns else F.struct("ordinal")).alias("first"))
    if limit is None:
        return rows.select("field", "value", F.col("n").alias("records"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy("first", "value"))
    head = rows.withColumn("rn", rank).filter(F.col("rn") <= limit).select("field", "value", F.lit(True).alias("kept"))
    # At most `limit` values for each of a handful of fields: small enough to send to every task.
    folded = rows.join(F.broadcast(head), ["field", "value"], "left")
    return folded.groupBy("field", F.when(F.col("kept"), F.col("value")).alias("value")).agg(F.sum("n").cast("bigint").alias("records"))


# ---- function-calling benchmark records --------------------------------------------

# Fields of the format and the JSON types they hold, the required ones, and its categories.
CALL_TEXT_FIELDS = {"functions": "ARRAY", "tools": "ARRAY", "turns": "ARRAY", "ground_truth": "ARRAY|OBJECT", "missed_functions": "OBJECT", "initial_config": "OBJECT"}
CALL_REQUIRED = ["id", "multi_turn", "functions", "tools", "turns", "language", "test_category", "subset", "ground_truth"]
CALL_CATEGORIES = ["language", "test_category", "subset"]


def is_call_benchmark(value: Column) -> Column:
    """Whether the fields are those of a function-calling benchmark row."""
    def has(k: str) -> str:
        return f"({J.get_sql('v', k)} IS NOT NULL)"
    cats = " AND ".join(has(k) for k in CALL_CATEGORIES)
    named = "coalesce(schema_of_variant(try_variant_get(v, '$.id', 'variant')) = 'STRING' AND length(try_variant_get(v, '$.test_category', 'string')) > 0 AND startswith(try_variant_get(v, '$.id', 'string'), try_variant_get(v, '$.test_category', 'string') || '_'), false)"
    notes = " + ".join(f"int({has(k)})" for k in ("missed_functions", "initial_config", "involved_classes"))
    return J.let_sql(value, f"coalesce(schema_of_variant(v) LIKE 'OBJECT%' AND ({has('functions')} OR {has('tools')}) AND ({has('turns')} OR {has('ground_truth')}) AND (({cats}) OR {named} OR {notes} >= 2), false)")


# Issues a row may have, in the order in which they are listed, and the roles counted by name.
CALL_ISSUES = ["missing-field", "malformed-json", "type-mismatch", "over-budget", "invalid-definition", "invalid-turn", "multi-turn-mismatch"]
CALL_ROLES = ["system", "user", "assistant", "tool", "function"]


def leaf_counts(value: Column) -> Column:
    """STRUCT(texts, objects): the non-empty strings that are values, and the objects, at any depth of a VARIANT.

    Counted on the serialised value: strings become one letter (with a quote behind it when
    they are empty), so nesting needs neither recursion nor a depth.
    """
    flat = F.regexp_replace(F.to_json(value), r"\\.", "x")
    skeleton = F.regexp_replace(flat, r'"(?=("?))[^"]*+"', "S$1")
    return F.transform(F.array(skeleton), lambda t: F.struct(
        F.regexp_count(t, F.lit(r'S(?![":])')).cast("bigint").alias("texts"), F.regexp_count(t, F.lit(r"\{")).cast("bigint").alias("objects")))[0]


def call_summary(records: DataFrame, key: tuple[str, ...] = ("source_id", "ordinal"), characters: int | None = None) -> DataFrame:
    """States and counts of the JSON-in-text fields of one benchmark row, and its issues.

    With `characters`, a longer field is over budget and not looked at. Counts of a field
    that is not valid are zero; turns are invalid when they are no list, and once for
    each message without a role.
    """
    lists = {**CALL_TEXT_FIELDS, "involved_classes": "ARRAY"}
    long = {f: "false" if characters is None else f"coalesce(length({J.string_sql('value', f)}) > {int(characters)}, false)" for f in lists}
    df = J.fence(records.filter(is_call_benchmark(F.col("value"))), **{f"_{f}": F.expr(
        f"if(schema_of_variant({J.get_sql('value', f)}) = 'STRING' AND NOT {long[f]}, try_parse_json('[' || try_variant_get(value, '$.{f}', 'string') || ',0]'), null)") for f in lists})
    states = {}
    for f, kinds in lists.items():
        g, inner = J.get_sql("value", f), f"schema_of_variant(try_variant_get(_{f}, '$[0]', 'variant'))"
        whole = f"try_variant_get(_{f}, '$[1]', 'bigint') = 0 AND try_variant_get(_{f}, '$[2]', 'variant') IS NULL"
        own = f"WHEN schema_of_variant({g}) LIKE 'ARRAY%' THEN if(size({_array('value', f)}) = 0, 'empty', 'valid') " if f == "involved_classes" else ""
        states[f"{f}_state"] = F.expr(
            f"CASE WHEN {g} IS NULL THEN 'missing' {own}WHEN schema_of_variant({g}) != 'STRING' THEN 'type-mismatch' WHEN try_variant_get({g}, '$', 'string') = '' THEN 'empty' WHEN {long[f]} THEN 'over-budget' "
            f"WHEN NOT coalesce({whole}, false) THEN 'malformed' WHEN NOT {inner} rlike '^({kinds})' THEN 'type-mismatch' WHEN {inner} IN ('OBJECT<>', 'ARRAY<VOID>') AND "
            f"coalesce(size(try_variant_get(_{f}, '$[0]', 'array<variant>')), size(map_keys(try_variant_get(_{f}, '$[0]', 'map<string,variant>')))) = 0 THEN 'empty' ELSE 'valid' END")
    df = J.fence(df, **states)
    df = J.fence(df, **{f"c_{f}": F.expr(f"if({f}_state = 'valid', try_variant_get(_{f}, '$[0]', 'variant'), null)") for f in CALL_TEXT_FIELDS},
                 _classes=F.expr(f"if(involved_classes_state = 'valid', coalesce({_array('value', 'involved_classes')}, try_variant_get(_involved_classes, '$[0]', 'array<variant>')), null)"))
    counts = {}
    items = {f: f"coalesce(try_variant_get(c_{f}, '$', 'array<variant>'), array())" for f in CALL_TEXT_FIELDS}
    bad_definition = []
    for f in ("functions", "tools"):
        inner = f"transform({items[f]}, d -> if(schema_of_variant({J.get_sql('d', 'function')}) LIKE 'OBJECT%', try_variant_get(d, '$.function', 'variant'), d))"
        good = f"filter({inner}, d -> schema_of_variant(try_variant_get(d, '$.name', 'variant')) = 'STRING')"
        counts[f"{f}_definitions"] = f"size({items[f]})"
        counts[f"{f}_valid"] = f"size({good})"
        counts[f"{f}_parameters"] = f"size(filter({good}, d -> schema_of_variant(try_variant_get(d, '$.parameters', 'variant')) LIKE 'OBJECT%'))"
        counts[f"{f}_required"] = f"aggregate({good}, 0, (n, d) -> n + coalesce(size(try_variant_get(d, '$.parameters.required', 'array<variant>')), 0))"
        bad_definition.append(f"size({items[f]}) > size({good})")
    roles = f"flatten(transform({items['turns']}, t -> transform(coalesce(try_variant_get(t, '$', 'array<variant>'), array()), m -> lower(if(schema_of_variant(try_variant_get(m, '$.role', 'variant')) = 'STRING', try_variant_get(m, '$.role', 'string'), null)))))"
    stray = f"size(filter({items['turns']}, t -> NOT coalesce(schema_of_variant(t) LIKE 'ARRAY%', false)))"
    counts |= {"turns": f"size({items['turns']})", "turn_messages": "size(filter(_roles, r -> r IS NOT NULL))", "invalid_turns": f"{stray} + size(filter(_roles, r -> r IS NULL))",
               **{f"{r}_messages": f"size(filter(_roles, r -> r = '{r}'))" for r in CALL_ROLES}, "other_messages": f"size(filter(_roles, r -> r NOT IN ({', '.join(repr(r) for r in CALL_ROLES)})))"}
    for f in ("missed_functions", "ground_truth"):
        counts |= {f"{f}_groups": f"coalesce(size(try_variant_get(c_{f}, '$', 'array<variant>')), size(map_keys(try_variant_get(c_{f}, '$', 'map<string,variant>'))), 0)",
                   f"{f}_calls": f"coalesce(n_{f}.texts, 0)", f"{f}_objects": f"coalesce(n_{f}.objects, 0)"}
    counts |= {"config_keys": "coalesce(size(map_keys(try_variant_get(c_initial_config, '$', 'map<string,variant>'))), 0)", "config_objects": "coalesce(n_initial_config.objects, 0)",
               "class_values": "size(_names)", "classes": "size(array_distinct(_names))"}
    df = J.fence(df, _roles=F.expr(roles), _names=F.expr("filter(transform(coalesce(_classes, array()), c -> if(schema_of_variant(c) = 'STRING', try_variant_get(c, '$', 'string'), null)), c -> c IS NOT NULL)"),
                 **{f"n_{f}": leaf_counts(F.col(f"c_{f}")) for f in ("missed_functions", "ground_truth", "initial_config")})
    multi = J.get_sql("value", "multi_turn")
    df = J.fence(df, **{n: F.expr(f"cast({c} AS bigint)") for n, c in counts.items()},
                 multi_turn=F.expr(f"CASE WHEN schema_of_variant({multi}) = 'BOOLEAN' THEN try_variant_get(value, '$.multi_turn', 'string') WHEN {multi} IS NULL THEN 'missing' ELSE 'invalid' END"))
    def any_state(state: str) -> str:
        return " OR ".join(f"{f}_state = '{state}'" for f in lists)
    blank = " OR ".join(f"coalesce(try_variant_get(value, '$.{c}', 'string') = '', false)" for c in CALL_CATEGORIES)
    odd = " OR ".join(f"({_has(c)} AND schema_of_variant({J.get_sql('value', c)}) != 'STRING')" for c in CALL_CATEGORIES)
    found = {"missing-field": " OR ".join(f"NOT {_has(f)}" for f in CALL_REQUIRED), "malformed-json": any_state("malformed"),
             "type-mismatch": f"{any_state('type-mismatch')} OR {odd} OR multi_turn = 'invalid' OR size(_names) < coalesce(size(_classes), 0)", "over-budget": f"{any_state('over-budget')} OR {blank}",
             "invalid-definition": " OR ".join(bad_definition), "invalid-turn": "invalid_turns > 0", "multi-turn-mismatch": "multi_turn = 'true' AND turns_state = 'valid' AND turns < 2"}
    issues = F.expr("filter(array(" + ", ".join(f"if({c}, '{i}', null)" for i, c in found.items()) + "), i -> i IS NOT NULL)")
    return J.fence(df, issues=issues).select(*key, *states, *counts, "multi_turn", *[F.expr(J.string_sql("value", c)).alias(c) for c in CALL_CATEGORIES], "issues", (F.size("issues") == 0).alias("valid"))


def call_totals(summaries: DataFrame) -> DataFrame:
    """Sums over the benchmark rows, the multi-turn split, and the rows that hold each field."""
    nums = [n for n, t in summaries.dtypes if t == "bigint" and n not in ("ordinal",)]
    held = [n for n in summaries.columns if n.endswith("_state")]
    return summaries.agg(F.count(F.lit(1)).alias("recognized"), F.count_if("valid").alias("valid"),
                         *[F.count_if(F.col("multi_turn") == s).alias(f"multi_turn_{s}") for s in ("true", "false", "missing", "invalid")],
                         *[F.count_if(F.col(n) != "missing").alias(n.replace("_state", "_records")) for n in held],
                         *[F.sum(n).cast("bigint").alias(n) for n in nums])


def call_issues(summaries: DataFrame) -> DataFrame:
    """Rows with each issue."""
    return summaries.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("records"))


def call_categories(summaries: DataFrame, limit: int | None = 32) -> DataFrame:
    """Rows per value of the three category fields; values beyond the first `limit` seen share one NULL row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in CALL_CATEGORIES])
    return categories(summaries.withColumn("_pairs", F.filter(pairs, lambda p: p["value"].isNotNull())), limit, "_pairs")


# ---- shapes ------------------------------------------------------------------------------

# Block types that mark tool use in a message.
TOOL_BLOCKS = ["tool_use", "tool_result", "tool_call", "function_call"]


def shape(value: Column) -> Column:
    """Training shape of a record, `conflict` when signals disagree, NULL when none fits."""
    def arr(k: str) -> str:
        return f"try_variant_get(v, '$.{k}', 'array<variant>')"
    def text(x: str, k: str) -> str:
        return f"schema_of_variant(try_variant_get({x}, '$.{k}', 'variant')) = 'STRING'"
    def has(k: str) -> str:
        return f"try_variant_get(v, '$.{k}', 'variant') IS NOT NULL"
    blocks = "coalesce(try_variant_get(m, '$.content', 'array<variant>'), array())"
    media = ", ".join(f"'{t}'" for ts in MEDIA_TYPES.values() for t in ts)
    tools = ", ".join(f"'{t}'" for t in TOOL_BLOCKS)
    is_tool = (f"exists({arr('messages')}, m -> try_variant_get(m, '$.role', 'string') IN ('tool', 'function') OR size(try_variant_get(m, '$.tool_calls', 'array<variant>')) > 0 "
               f"OR exists({blocks}, b -> try_variant_get(b, '$.type', 'string') IN ({tools})))")
    is_media = f"exists({arr('messages')}, m -> exists({blocks}, b -> try_variant_get(b, '$.type', 'string') IN ({media})))"
    plain = f"forall({arr('messages')}, m -> {text('m', 'role')} AND ({text('m', 'content')} OR try_variant_get(m, '$.content', 'array<variant>') IS NOT NULL))"
    pairs = f"size({arr('conversation')}) > 0 AND forall({arr('conversation')}, m -> {text('m', 'human')} AND {text('m', 'assistant')})"
    talk = f"size({arr('conversations')}) > 0 AND forall({arr('conversations')}, m -> {text('m', 'from')} AND {text('m', 'value')})"
    keyword = " AND ".join(text("v", k) for k in ("input", "predict", "target"))
    home = f"{text('v', 'task')} AND (NOT {has('description')} OR {text('v', 'description')}) AND (NOT {has('action_list')} OR {arr('action_list')} IS NOT NULL) AND (NOT {has('FailReasons')} OR {arr('FailReasons')} IS NOT NULL)"
    branches = f"{arr('chosen_messages')} IS NOT NULL OR {arr('rejected_messages')} IS NOT NULL"
    cases = (
        f"WHEN {has('conversation')} THEN if({pairs}, 'sft-master-conversation', null) WHEN {has('input')} OR {has('predict')} OR {has('target')} THEN if({keyword}, 'keyword-result', null) "
        f"WHEN {has('conversations')} THEN if({talk}, 'sharegpt', null) WHEN {has('task')} OR {has('description')} OR {has('action_list')} OR {has('FailReasons')} THEN if({home}, 'virtualhome', null) "
        f"WHEN {branches} THEN if(size({arr('chosen_messages')}) > 0 AND size({arr('rejected_messages')}) > 0, 'preference', null) "
        f"WHEN size({arr('messages')}) > 0 THEN CASE WHEN {is_tool} AND {is_media} THEN 'conflict' WHEN {is_tool} THEN 'tool-use' WHEN {is_media} THEN 'multimodal' WHEN {plain} THEN 'sft' END"
    )
    return J.let_sql(value, f"CASE {cases} END")


def detect_shape(records: DataFrame) -> DataFrame:
    """One shape when every record has it, else why not: one row per source."""
    counted = records.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("value").isNull()).alias("bad"), F.count_if(shape(F.col("value")) == "conflict").alias("clash"),
        F.count(shape(F.col("value"))).alias("shaped"), F.min(shape(F.col("value"))).alias("low"), F.max(shape(F.col("value"))).alias("high"))
    code = F.when(F.col("bad") > 0, "invalid_sample").when((F.col("clash") > 0) | (F.col("low") != F.col("high")), "conflicting_shapes").when(F.col("shaped") < F.col("records"), "unknown_shape")
    return counted.select("source_id", F.when(code.isNull(), F.col("low")).alias("shape"), code.alias("fallback"))


# The fields each shape reads.
SHAPE_FIELDS = {
    "sft": ["messages"], "tool-use": ["messages", "tools"], "multimodal": ["messages"], "preference": ["chosen_messages", "rejected_messages"],
    "sharegpt": ["conversations", "system", "tools"], "sft-master-conversation": ["conversation", "category", "dataset", "conversation_id"],
    "keyword-result": ["input", "predict", "target"], "virtualhome": ["task", "description", "action_list", "FailReasons", "SuccessOrFail"],
}


def shape_fields(records: DataFrame, key: tuple[str, ...] = ("source_id", "ordinal")) -> DataFrame:
    """(field, path, count) rows of each shaped record; count is the length of a list, else 1."""
    rows = "map(" + ", ".join(f"'{s}', array({', '.join(repr(f) for f in fs)})" for s, fs in SHAPE_FIELDS.items()) + ")"
    df = J.fence(records, _shape=shape(F.col("value")), _f=F.expr("try_variant_get(value, '$', 'map<string,variant>')"))
    df = df.select(*key, "_f", F.explode(F.expr(f"element_at({rows}, _shape)")).alias("field"))
    leaf = F.expr("element_at(_f, field)")
    return df.filter(leaf.isNotNull()).select(*key, "field", F.concat(F.lit("$."), "field").alias("path"),
                                              F.coalesce(F.size(F.expr("try_variant_get(element_at(_f, field), '$', 'array<variant>')")), F.lit(1)).cast("bigint").alias("count"))
