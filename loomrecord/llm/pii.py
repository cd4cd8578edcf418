"""Personal data: fixed forms, and identifiers found by bootstrapped contexts. DataFrame functions only.

The fixed forms are the seeds. The words before a seed are a lexical pattern; patterns
and the identifier-like tokens they stand before form a graph, on which Spark passes
scores to and fro: a pattern is as good as the share of its tokens that are known, a
token as good as the patterns that vouch for it. Tokens behind patterns of high
confidence are identifiers too, though none of the fixed forms matches them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.functions.jsonvalue import fence
from loomrecord.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: The contract's forms, written so that no text makes them backtrack: possessive, and started only where a run starts.
#: Cards and single runs of digits are maximal, so a run of another number of digits can be skipped inside the form.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+",
}
EDGES = "\"'()[]{}<>.,;:!?*#$%&|"


def _present(kind: str, t: str) -> Column:
    if kind == "email":
        return F.contains(F.col(t), F.lit("@"))
    return F.col("__digit") | F.contains(F.col(t), F.lit("@")) if kind == "token" else F.col("__digit")


def _valid(kind: str, x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce((F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.ltrim(p, F.lit("0")).try_cast("int").isNull() | (F.ltrim(p, F.lit("0")).try_cast("int") <= 255)), F.lit(False)))
    if kind == "card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


#: Prefix sums go by blocks of this length, so that their cost stays near the number of matches.
BLOCK = 64


def _block_sums(lengths: str) -> Column:
    """For each block of BLOCK lengths, the sum of all before it."""
    return F.expr(f"""aggregate(sequence(0, cast(size({lengths}) / {BLOCK} AS int)), struct(0 AS at, cast(array() AS array<int>) AS out),
        (a, b) -> struct(a.at + aggregate(slice({lengths}, b * {BLOCK} + 1, {BLOCK}), 0, (t, x) -> t + x) AS at, array_append(a.out, a.at) AS out), a -> a.out)""")


def _located(matches: str, lengths: str, sums: str) -> Column:
    """Matches with their places: lengths holds each gap with the match behind it."""
    return F.expr(f"""transform(transform({matches}, (x, i) -> struct(x AS value,
            {sums}[cast(i / {BLOCK} AS int)] + aggregate(slice({lengths}, cast(i / {BLOCK} AS int) * {BLOCK} + 1, i % {BLOCK} + 1), 0, (t, y) -> t + y) AS end)),
        x -> struct(x.end - length(x.value) AS start, x.end AS end, x.value AS value))""")


def base_spans(docs: DataFrame, text: str = "text", tokens: bool = True) -> DataFrame:
    """docs with `__base` (kind -> located valid matches) and `__tokens` (identifier-like tokens with the words before them)."""
    kinds = [*KINDS, *(["token"] if tokens else [])]
    a = fence(docs, __t=F.coalesce(F.col(text), F.lit("")))
    a = fence(a, __digit=F.col("__t").rlike("[0-9]"))
    none = F.array().cast("array<string>")
    a = fence(a, **{f"__m_{k}": F.when(_present(k, "__t"), F.regexp_extract_all("__t", F.lit(FORMS[k]), F.lit(0))).otherwise(none) for k in kinds})
    a = fence(a, **{f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.split("__t", FORMS[k], -1)).otherwise(none) for k in kinds})
    a = fence(a, **{f"__n_{k}": F.expr(f"transform(__m_{k}, (x, i) -> length(__g_{k}[i]) + length(x))") for k in kinds})
    a = fence(a, **{f"__b_{k}": F.when(F.size(f"__n_{k}") > 0, _block_sums(f"__n_{k}")) for k in kinds})
    a = fence(a, **{f"__s_{k}": _located(f"__m_{k}", f"__n_{k}", f"__b_{k}") for k in kinds})
    def checked(kind: str) -> Column:
        return F.filter(f"__s_{kind}", lambda s: _valid(kind, s["value"])).alias(kind)
    base = F.struct(*map(checked, KINDS))
    a = fence(a, __base=base)
    keep = [*docs.columns, "__base"]
    if not tokens:
        return a.select(*keep)
    # The last two words between the token before and this one; <id> is a token, <s> the start of the text.
    words = F.transform("__g_token", lambda g, i: F.slice(F.concat(F.array(F.lit("<s>"), F.when(i == 0, F.lit("<s>")).otherwise(F.lit("<id>"))), F.filter(F.split(F.lower(g), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")), -2, 2))
    a = fence(a, __c=F.transform(words, lambda w: F.array_join(w, " ")))
    flat = F.flatten(F.array(*[F.col(f"__base.{k}") for k in KINDS]))
    a = fence(a, __flat=flat)
    found = F.transform("__s_token", lambda s, i: F.struct(
        F.get("__c", i).alias("pattern"),
        (s["start"] + F.length(s["value"]) - F.length(F.ltrim(s["value"], F.lit(EDGES)))).alias("start"),
        (s["end"] - F.length(s["value"]) + F.length(F.rtrim(s["value"], F.lit(EDGES)))).alias("end"),
        F.lower(F.trim(s["value"], F.lit(EDGES))).alias("value"),
        F.exists("__flat", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])).alias("seed")))
    return a.select(*keep, F.filter(found, lambda x: F.length(x["value"]) > 0).alias("__tokens"))


def confident_patterns(tokens: DataFrame, rounds: int = 3, least_seeds: int = 3, confidence: float = 0.8) -> DataFrame:
    """(pattern, score): patterns of at least `least_seeds` different seeds whose score reaches `confidence`.

    `tokens` has pattern, value and seed, a row for each occurrence. Counting is of
    different values, so copies of a text add nothing. Every table here is an aggregate
    by pattern or value.
    """
    usable = ~F.col("pattern").endswith("<id>") & ~F.col("pattern").endswith("<s>")
    edges = tokens.where(usable).groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    able = written(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("int")).alias("seeds")).where(F.col("seeds") >= least_seeds), "patterns")
    edges = written(edges.join(able.select("pattern", "n"), "pattern").withColumn("known", F.col("seed").cast("double")), "edges")
    scores = None
    for i in range(rounds):
        scores = written(edges.groupBy("pattern").agg((F.sum("known") / F.max("n")).alias("score")), "scores")
        if i + 1 < rounds:
            voted = edges.drop("known").join(scores, "pattern")
            values = voted.groupBy("value").agg(F.when(F.max("seed"), F.lit(1.0)).otherwise(1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("known"))
            edges = written(edges.drop("known").join(values, "value"), "edges")
    return scores.where(F.col("score") >= confidence)


def find_pii(docs: DataFrame, text: str = "text", rounds: int = 3, least_seeds: int = 3, confidence: float = 0.8, key: str = "doc_id") -> DataFrame:
    """All columns of docs and a struct `pii`: email, ip, card, phone (base spans) and id (spans the contexts add).

    Spans hold start, end (code points, end exclusive) and value, in order of start.
    Added spans never overlap base ones. Null and empty texts have no spans. Rows equal
    in key and text get the same spans; copies count once as evidence. A column named pii
    is replaced; extra columns pass through. Only the tokens are written between the two
    passes over the texts, never the texts.
    """
    docs = docs.drop("pii")
    place = [F.col(key).alias("__key"), F.xxhash64(text).alias("__tag")]
    tokens = written(base_spans(docs.select(key, text), text).where(F.size("__tokens") > 0).select(*place, F.inline("__tokens")), "tokens")
    good = confident_patterns(tokens, rounds, least_seeds, confidence).select("pattern")
    added = tokens.where(~F.col("seed")).join(good, "pattern").groupBy("__key", "__tag").agg(F.array_sort(F.collect_set(F.struct("start", "end", "value"))).alias("__id"))
    found = base_spans(docs, text, tokens=False).withColumn("__mark", F.xxhash64(text))
    joined = found.join(added, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__mark") == F.col("__tag")), "left")
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return joined.select(*docs.columns, F.struct(*[F.col(f"__base.{k}").alias(k) for k in KINDS], F.coalesce("__id", empty).alias("id")).alias("pii"))


def span_text(kinds: tuple[str, ...], pii: str = "pii") -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    def named(kind: str) -> Column:
        return F.transform(f"{pii}.{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.flatten(F.array(*map(named, kinds))), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """`text` with every span of `pii` replaced by its kind in brackets; overlapping spans become one, named after the first."""
    def placed(kind: str) -> Column:
        return F.transform(f"pii.{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    spans = F.array_sort(F.flatten(F.array(*map(placed, (*KINDS, "id")))))
    merged = fence(found, __r=spans)
    merged = fence(merged, __r2=F.expr("""aggregate(__r, cast(array() AS array<struct<start:int,end:int,kind:string>>), (a, s) ->
        CASE WHEN size(a) > 0 AND a[size(a) - 1].end > s.start
             THEN array_append(slice(a, 1, size(a) - 1), struct(a[size(a) - 1].start AS start, greatest(a[size(a) - 1].end, s.end) AS end, a[size(a) - 1].kind AS kind))
             ELSE array_append(a, s) END)"""))
    parts = F.transform("__r2", lambda s, i: F.concat(
        F.substring(F.col(text), F.when(i == 0, F.lit(1)).otherwise(F.get("__r2", i - 1)["end"] + 1), s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get("__r2", i - 1)["end"])), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.substring(F.col(text), F.get("__r2", F.size("__r2") - 1)["end"] + 1, F.length(text))
    fresh = F.when(F.size("__r2") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col(text))
    return merged.select(*[fresh.alias(c) if c == text else F.col(c) for c in found.columns])
