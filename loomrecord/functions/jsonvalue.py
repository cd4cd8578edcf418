"""Column functions over dynamic JSON values held as VARIANT.

Missing and JSON null differ everywhere: a missing path is SQL NULL, a JSON null
is a present variant for which ``is_json_null`` is true. Everything here is a
built-in expression, so it stays inside code generation on the executors.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Token = str | int
_IDENTIFIER = re.compile(r"^[A-Za-z_$][A-Za-z0-9_$]*$")
# Characters that a script engine's trim() removes, for "blank" tests.
BLANK_CLASS = (
    r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
)


def jsonpath(*tokens: Token, quote: str = '"') -> str:
    """Render path tokens as JSONPath text: $.name, $["odd key"], $[0]."""
    out = ["$"]
    for token in tokens:
        if isinstance(token, int):
            out.append(f"[{token}]")
        elif re.match(r"^[A-Za-z_][A-Za-z0-9_]*$", token):
            out.append(f".{token}")
        elif quote not in token:
            out.append(f"[{quote}{token}{quote}]")
        elif "'" not in token:
            out.append(f"['{token}']")
        else:
            raise ValueError("a key holding both quote characters cannot be addressed")
    return "".join(out)


def sql_text(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def get_sql(value: str, *tokens: Token) -> str:
    """`get` as SQL text, for alias tables too long to build call by call."""
    return f"try_variant_get({value}, {sql_text(jsonpath(*tokens))}, 'variant')"


def get(value: Column, *tokens: Token) -> Column:
    """The variant at a path; SQL NULL when missing."""
    return F.try_variant_get(value, jsonpath(*tokens), "variant")


def is_json_null(value: Column) -> Column:
    return F.coalesce(F.is_variant_null(value), F.lit(False))


def let(value: Column, use) -> Column:
    """Bind an expression once: `use(x)` may mention x often without re-evaluating it."""
    return F.transform(F.array(value), use)[0]


def let_sql(value: Column, body: str, name: str = "v") -> Column:
    """`let` with the body as SQL text over the variable `name`: few calls for long bodies."""
    return F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}"))[0]


def bind_sql(value: str, name: str, body: str) -> str:
    """SQL text that binds a value once for a body mentioning it often."""
    return f"transform(array({value}), {name} -> {body})[0]"


def fence(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, whatever is asked of them later.

    A filter over a projected column is pushed below the projection and evaluates
    the column's expression again for every mention. Columns that come out of a
    one-element generator stay as they are, so costly parsing is never repeated.
    They are computed in a projection below the generator: a generator outside a fused
    stage interprets its expressions and repeats their common parts.
    """
    built = df.select("*", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_fence"))
    return built.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array("_fence")))


def _schema(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return F.coalesce(_schema(value) == "STRING", F.lit(False))


def is_boolean(value: Column) -> Column:
    return F.coalesce(_schema(value) == "BOOLEAN", F.lit(False))


def is_numeric(value: Column) -> Column:
    return F.coalesce(_schema(value).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.lit(False))


def is_object_sql(value: str) -> str:
    """Whether a value is an object; its fields are not looked into, as its schema would be."""
    return f"(try_variant_get({value}, '$', 'struct<_:variant>') IS NOT NULL)"


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "struct<_:variant>").isNotNull()


def is_array(value: Column) -> Column:
    return F.coalesce(_schema(value).startswith("ARRAY"), F.lit(False))


def as_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def as_array(value: Column) -> Column:
    """ARRAY<VARIANT>, or NULL when the value is not an array."""
    return F.try_variant_get(value, "$", "array<variant>")


def as_map(value: Column) -> Column:
    """MAP<STRING,VARIANT>, or NULL when the value is not an object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def kind(value: Column) -> Column:
    """Object, array, string, integer, number, boolean or null; NULL if missing.

    Integer is decided by value, so 1.0 and 1e3 are integers.
    """
    shape = F.regexp_replace(F.substring_index(_schema(value), "<", 1), r"^DECIMAL\(\d+,0\)$", "BIGINT")
    whole_double = F.when((_schema(value) == "DOUBLE") & (as_double(value) % 1 == 0), "integer")
    return F.coalesce(whole_double, lookup(SCHEMA_KINDS, F.substring_index(shape, "(", 1)))


# JSON kind of each variant type.
SCHEMA_KINDS = {
    "OBJECT": "object", "ARRAY": "array", "STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "VOID": "null",
    "DECIMAL": "number", "DOUBLE": "number",
}


def string_at(value: Column, *tokens: Token, allow_empty: bool = False) -> Column:
    """A string found at a path, else NULL. Empty strings count as absent by default."""
    leaf = get(value, *tokens) if tokens else value
    text = as_string(leaf)
    ok = is_string(leaf)
    return F.when(ok if allow_empty else ok & (F.length(text) > 0), text)


def number_at(value: Column, *tokens: Token) -> Column:
    leaf = get(value, *tokens) if tokens else value
    number = as_double(leaf)
    finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(is_numeric(leaf) & finite, number)


def boolean_at(value: Column, *tokens: Token) -> Column:
    leaf = get(value, *tokens) if tokens else value
    return F.when(is_boolean(leaf), F.try_variant_get(leaf, "$", "boolean"))


def object_at(value: Column, *tokens: Token) -> Column:
    leaf = get(value, *tokens)
    return F.when(is_object(leaf), leaf)


def array_at(value: Column, *tokens: Token) -> Column:
    return F.try_variant_get(value, jsonpath(*tokens), "array<variant>")


def fields(value: Column, *keys: str) -> Column:
    """STRUCT of an object's fields, each a variant or SQL NULL when missing; NULL unless it is an object.

    One pass over the object, whatever the number of keys. Names that differ in case alone
    need structs of their own.
    """
    return F.try_variant_get(value, "$", "struct<" + ",".join(f"`{k}`:variant" for k in keys) + ">")


def present(value: Column, *tokens: Token) -> Column:
    """A path that exists and is not JSON null (the nullish test)."""
    leaf = get(value, *tokens)
    return leaf.isNotNull() & ~is_json_null(leaf)


def non_null(value: Column, *tokens: Token) -> Column:
    """The variant at a path, or NULL when it is missing or JSON null."""
    leaf = get(value, *tokens)
    return F.when(~is_json_null(leaf), leaf)


def first_present(value: Column, *paths: tuple[Token, ...]) -> Column:
    """The first alias that is present and not JSON null."""
    return F.coalesce(*[non_null(value, *p) for p in paths])


def first_string(value: Column, *paths: tuple[Token, ...]) -> Column:
    return F.coalesce(*[string_at(value, *p) for p in paths])


def first_number(value: Column, *paths: tuple[Token, ...]) -> Column:
    return F.coalesce(*[number_at(value, *p) for p in paths])


def number_text(number: Column) -> Column:
    """Script-style text of a numeric variant: whole values print without a fraction."""
    return F.regexp_replace(as_string(number), r"\.0$", "")


def scalar_text(value: Column) -> Column:
    """Text of a string (non-empty) or number; NULL for anything else."""
    text = F.when(is_string(value), as_string(value)).when(is_numeric(value), number_text(value))
    return F.nullif(text, F.lit(""))


def display_step(token: Column) -> Column:
    """Text of one path token: .key or ["key"], [i]."""
    key = token["key"]
    quoted = F.concat(F.lit('["'), F.regexp_replace(F.regexp_replace(key, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"]'))
    plain = key.rlike(_IDENTIFIER.pattern)
    return (
        F.when(key.isNull(), F.concat(F.lit("["), token["idx"].cast("string"), F.lit("]")))
        .when(plain, F.concat(F.lit("."), key))
        .otherwise(quoted)
    )


def display_path(path: Column) -> Column:
    """J3 over ARRAY<STRUCT<key STRING, idx INT>>: $, .key or ["key"], [i]."""
    return F.aggregate(path, F.lit("$"), lambda acc, token: F.concat(acc, display_step(token)))


def display_literal(*tokens: Token) -> str:
    """J3 for a path known while planning."""
    out = "$"
    for token in tokens:
        if isinstance(token, int):
            out += f"[{token}]"
        elif _IDENTIFIER.match(token):
            out += f".{token}"
        else:
            escaped = token.replace("\\", "\\\\").replace('"', '\\"')
            out += f'["{escaped}"]'
    return out


def compact_json(text: Column, *tokens: Token) -> Column:
    """Compact JSON of a container inside the original text, in source key order.

    A VARIANT sorts its keys, so the source text is re-serialised instead.
    Float tokens are printed as doubles; a whole one loses its ".0".
    """
    return whole_numbers(F.get_json_object(text, jsonpath(*tokens, quote="'")))


def whole_numbers(out: Column) -> Column:
    """JSON text with whole floats printed without a fraction."""
    whole_floats = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(-?\d+)\.0+(?=[,\]}]|$)'
    return F.when(out.rlike(r"\d\.0+(?:[,\]}]|$)"), F.regexp_replace(out, whole_floats, "$1$2")).otherwise(out)


def searchable_text(text: Column, value: Column, *tokens: Token) -> Column:
    """Strings as they are, other scalars as text, containers as compact JSON."""
    leaf = get(value, *tokens) if tokens else value
    return (
        F.when(is_json_null(leaf), F.lit("null"))
        .when(is_string(leaf) | is_boolean(leaf), as_string(leaf))
        .when(is_numeric(leaf), number_text(leaf))
        .when(leaf.isNotNull(), compact_json(text, *tokens))
    )


def cell(text: Column, value: Column, *tokens: Token, max_chars: int = 240) -> Column:
    """struct(kind, value, preview, truncated) of one projected field."""
    leaf = get(value, *tokens) if tokens else value
    body = searchable_text(text, value, *tokens)
    container = is_object(leaf) | is_array(leaf)
    long = F.length(body) > max_chars
    return F.struct(
        kind(leaf).alias("kind"),
        F.when(~container & ~long, body).alias("value"),
        F.when(container | long, F.substring(body, 1, max_chars)).alias("preview"),
        F.coalesce(long, F.lit(False)).alias("truncated"),
    )


# Keys tried in this order when an object needs a one-line text.
SUMMARY_KEYS = ["message", "text", "content", "summary", "description", "name", "type"]


def collapse_sql(text: str, max_chars: int = 240) -> str:
    controls, blanks = sql_text(r"[\x00-\x1f\x7f]+"), sql_text(BLANK_CLASS + "+")
    flat = f"trim(regexp_replace(regexp_replace({text}, {controls}, ' '), {blanks}, ' '))"
    cut = f"CASE WHEN t = '' THEN 'Record' WHEN length(t) > {max_chars} THEN concat(substring(t, 1, {max_chars - 3}), '...') ELSE t END"
    return bind_sql(flat, "t", cut)


def collapse(text: Column, max_chars: int = 240) -> Column:
    """Control characters and runs of white space to one space, bounded with an ellipsis."""
    return let_sql(text, collapse_sql("txt", max_chars), "txt")


def string_sql(value: str, *tokens: Token) -> str:
    """A non-empty string at a path, else NULL."""
    leaf = get_sql(value, *tokens) if tokens else value
    return f"if(schema_of_variant({leaf}) = 'STRING', nullif(try_variant_get({leaf}, '$', 'string'), ''), null)"


def number_sql(value: str, *tokens: Token) -> str:
    leaf = get_sql(value, *tokens) if tokens else value
    return f"if(schema_of_variant({leaf}) rlike '^(BIGINT|DOUBLE|DECIMAL)', try_variant_get({leaf}, '$', 'double'), null)"


def nonnull_sql(value: str, *tokens: Token) -> str:
    g = get_sql(value, *tokens)
    return f"if(is_variant_null({g}), null, {g})"


def coalesce_sql(*parts: str) -> str:
    return f"coalesce({', '.join(parts)}, null)"


def scalar_sql(value: str) -> str:
    """Text of a non-empty string or a number, else NULL."""
    text = f"try_variant_get({value}, '$', 'string')"
    return (
        f"CASE WHEN schema_of_variant({value}) = 'STRING' THEN nullif({text}, '') "
        f"WHEN schema_of_variant({value}) rlike '^(BIGINT|DOUBLE|DECIMAL)' THEN regexp_replace({text}, '[.]0$', '') END"
    )


def block_text_sql(items: str, max_blocks: int = 16) -> str:
    text = f"if(schema_of_variant(b) = 'STRING', try_variant_get(b, '$', 'string'), {coalesce_sql(string_sql('b', 'text'), string_sql('b', 'content'))})"
    texts = f"filter(transform(slice({items}, 1, {max_blocks}), b -> {text}), x -> x IS NOT NULL)"
    return bind_sql(texts, "parts", "if(size(parts) > 0, array_join(parts, ' '), null)")


def block_text(items: Column, max_blocks: int = 16) -> Column:
    """Join the text (else content) of the leading blocks; NULL when none has any."""
    return let_sql(items, block_text_sql("items", max_blocks), "items")


def extract_text_sql(value: str) -> str:
    items = f"try_variant_get({value}, '$', 'array<variant>')"
    return f"if(schema_of_variant({value}) = 'STRING', try_variant_get({value}, '$', 'string'), {block_text_sql(items)})"


def extract_text(value: Column) -> Column:
    """J8 for a string or an array of blocks."""
    return let_sql(value, extract_text_sql("v"))


def _render_sql(value: str, depth: int) -> str:
    """Text of a value: a scalar, the text of blocks, or an object's first useful key."""
    n = f"n{depth}"
    items = f"try_variant_get({n}.v, '$', 'array<variant>')"
    text = f"try_variant_get({n}.v, '$', 'string')"
    cases = (
        f"WHEN {n}.s = 'VOID' THEN 'null' WHEN {n}.s IN ('STRING', 'BOOLEAN') THEN {text} "
        f"WHEN {n}.s = 'ARRAY' THEN coalesce({block_text_sql(items)}, concat('[', size({items}), ' items]')) "
    )
    if depth > 0:
        inner = [f"nullif({_render_sql(get_sql(n + '.v', key), depth - 1)}, '')" for key in SUMMARY_KEYS]
        keys = f"concat('{{', array_join(slice(map_keys(try_variant_get({n}.v, '$', 'map<string,variant>')), 1, 5), ', '), '}}')"
        cases += f"WHEN {n}.s = 'OBJECT' THEN coalesce({', '.join(inner)}, {keys}) "
    else:
        cases += f"WHEN {n}.s = 'OBJECT' THEN null "
    cases += f"WHEN {n}.s IS NOT NULL THEN regexp_replace({text}, '[.]0$', '')"
    node = f"named_struct('v', {value}, 's', substring_index(substring_index(schema_of_variant({value}), '<', 1), '(', 1))"
    return bind_sql(node, n, f"CASE {cases} END")


def bounded_summary(value: Column, prefix: Column | str | None = None, max_chars: int = 240, depth: int = 1) -> Column:
    """One-line text of any value. Objects are searched `depth` levels for a useful key."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    if head is None:
        head = F.lit(None).cast("string")
    node = F.struct(head.alias("head"), value.alias("value"))
    line = f"coalesce(nullif(concat_ws(': ', o.head, nullif({_render_sql('o.value', depth)}, '')), ''), 'Record')"
    return let_sql(node, collapse_sql(line, max_chars), "o")


# Alias names of token counters.
USAGE_ALIASES = {
    "input": ["input", "input_tokens", "inputTokens"],
    "output": ["output", "output_tokens", "outputTokens"],
    "cached": ["cached", "cached_tokens", "cache_read_input_tokens", "cached_input_tokens"],
    "total": ["total", "total_tokens", "totalTokens"],
}


def _first_number_sql(value: str, keys: list[str]) -> str:
    return coalesce_sql(*[number_sql(value, k) for k in keys])


def usage_sql(value: str) -> str:
    fields = ", ".join(f"'{name}', {_first_number_sql(value, keys)}" for name, keys in USAGE_ALIASES.items())
    return bind_sql(f"named_struct({fields})", "u", "if(coalesce(u.input, u.output, u.cached, u.total) IS NULL, null, u)")


def usage(value: Column) -> Column:
    """struct(input, output, cached, total), NULL when no counter is present."""
    return let_sql(value, usage_sql("v"))


def usage_generic_sql(value: str) -> str:
    first = {name: _first_number_sql(value, keys) for name, keys in USAGE_ALIASES.items()}
    raw = (
        f"named_struct('i', {first['input']}, 'o', {first['output']}, 'c', {first['cached']}, 't', {first['total']}, "
        f"'other', {number_sql(value, 'inputOther')}, 'hit', {number_sql(value, 'inputCacheRead')})"
    )
    inp = "coalesce(r.i, if(r.other IS NULL AND r.hit IS NULL, null, coalesce(r.other, 0D) + coalesce(r.hit, 0D)))"
    built = f"named_struct('input', {inp}, 'output', r.o, 'cached', coalesce(r.c, r.hit), 'total', r.t)"
    total = "named_struct('input', u.input, 'output', u.output, 'cached', u.cached, 'total', coalesce(u.total, u.input + u.output))"
    return bind_sql(bind_sql(raw, "r", built), "u", f"if(coalesce(u.input, u.output, u.cached, u.total) IS NULL, null, {total})")


def usage_generic(value: Column) -> Column:
    """As usage, with input = inputOther + inputCacheRead and a derived total."""
    return let_sql(value, usage_generic_sql("v"))


def content_state_sql(value: str, depth: int = 0) -> str:
    n, w = f"c{depth}", f"w{depth}"
    cases = (
        f"WHEN {n}.s IS NULL OR {n}.s = 'VOID' THEN 'missing' "
        f"WHEN {n}.s = 'STRING' THEN if(try_variant_get({n}.v, '$', 'string') = '', 'empty', 'present') "
        f"WHEN {n}.s = 'ARRAY' THEN if(try_variant_get({n}.v, '$[0]', 'variant') IS NULL, 'empty', 'present') "
    )
    if depth < 2:
        # A nullish wrapper falls through to the next one; only the last keeps a JSON null.
        v = f"{n}.v"
        inner = f"coalesce({nonnull_sql(v, 'content')}, {nonnull_sql(v, 'value')}, {get_sql(v, 'text')})"
        opened = bind_sql(inner, w, f"if({w} IS NULL, 'present', {content_state_sql(w, depth + 1)})")
        cases += f"WHEN {n}.s = 'OBJECT' THEN {opened} "
    node = f"named_struct('v', {value}, 's', substring_index(schema_of_variant({value}), '<', 1))"
    return bind_sql(node, n, f"CASE {cases} ELSE 'present' END")


def content_state(value: Column) -> Column:
    """Present, empty or missing; up to two content/value/text wrappers are opened."""
    return let_sql(value, content_state_sql("v"))


# Speaker names and the role each stands for.
ROLE_NAMES = {
    "human": "user", "user": "user",
    "gpt": "assistant", "model": "assistant", "bot": "assistant", "assistant": "assistant",
    "system": "system", "developer": "system",
    "tool": "tool", "observation": "tool",
    "function": "function", "function_call": "function",
}


def map_literal(mapping: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(sql_text(x) for pair in mapping.items() for x in pair) + ")")


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """A small fixed table as a map literal; NULL when the key is not listed."""
    return F.element_at(map_literal(mapping), key)


def role_of(value: Column) -> Column:
    """Normalised speaker role; anything unlisted is unknown."""
    return F.coalesce(lookup(ROLE_NAMES, F.lower(F.when(is_string(value), as_string(value)))), F.lit("unknown"))
