"""Quality rules whose cutoffs are certified on labelled holdouts. DataFrame functions only.

Every rule rejects texts whose share of something exceeds a cutoff. For each stratum
and rule, cutoffs are tested from the loosest on: an exact binomial bound must show, at
a level divided by the number of strata and rules, that at most its part of `alpha` of
good texts would be rejected. Of the certified cutoffs the one that best separates the
labels is taken; where none separates or none can be certified, the rule rejects nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrecord.functions.jsonvalue import fence
from loomrecord.llm.common import written

#: Symbols counted by the contract (fixed value).
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Cutoffs are multiples of 1 / STEPS.
STEPS = 100
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "lines": "n_dup_lines / greatest(n_lines, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
}


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct `quality`: the base counts and those the rules need. Null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    first = fence(docs, __t=t, __w=F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), __l=F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    grams = F.expr("""CASE WHEN size(__w) < 3 THEN array() ELSE sort_array(transform(sequence(0, size(__w) - 3), i -> struct(xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2)) AS h, i AS p))) END""")
    second = fence(first, __g=grams)
    again = F.expr("sort_array(transform(filter(__g, (x, i) -> coalesce(get(__g, i - 1).h = x.h, false) OR coalesce(get(__g, i + 1).h = x.h, false)), x -> x.p))")
    third = fence(second, __p=again)
    without = lambda letters: F.length("__t") - F.length(F.translate("__t", letters, ""))
    long = lambda c: c.cast("bigint")
    made = F.struct(
        long(F.size("__w")).alias("n_words"),
        long(F.length("__t") - F.length(F.translate("__t", " \t\n\x0b\x0c\r", ""))).alias("white"),
        long(F.length("__t")).alias("chars"),
        long(without(SYMBOLS)).alias("n_symbols"),
        long(F.size("__l") - F.size(F.array_distinct("__l"))).alias("n_dup_lines"),
        long(F.size("__l")).alias("n_lines"),
        long(F.expr("aggregate(__p, struct(-3 AS last, 0 AS n), (a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n), a -> a.n)")).alias("n_repeat_words"),
        long(without(UPPER)).alias("n_upper"),
        long(without("!?;=+~^_{}[]\\/@\"")).alias("n_marks"),
    )
    full = fence(third, __q=made)
    q = F.col("__q")
    quality = q.withField("word_chars", q["chars"] - q["white"]).withField("base_failed", (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])).dropFields("white", "chars")
    return full.select(*[c for c in docs.columns if c != "quality"], quality.alias("quality"))


def upper_tail(n: str, k: str, rate: str) -> Column:
    """P(at most k of n) when each happens with probability `rate`: exact, summed in logarithms."""
    return F.expr(f"""least(1D, exp(aggregate(filter(sequence(0, cast({k} AS int)), i -> i > 0),
        struct({n} * ln(1 - {rate}) AS t, {n} * ln(1 - {rate}) AS s),
        (a, i) -> named_struct('t', a.t + ln(({n} - i + 1) / i) + ln({rate} / (1 - {rate})),
            's', greatest(a.s, a.t + ln(({n} - i + 1) / i) + ln({rate} / (1 - {rate}))) + ln(1 + exp(-abs(a.s - (a.t + ln(({n} - i + 1) / i) + ln({rate} / (1 - {rate}))))))),
        a -> a.s)))""")


def certify(scored: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.1, stratum: str = "lang", key: str = "doc_id") -> DataFrame:
    """(stratum, cutoffs map rule -> cutoff): with probability 1 - delta, no stratum's good texts are rejected more often than alpha.

    `scored` has key, stratum and `quality`; `labels` has key and `quality` (1 good, 0
    not; others and nulls are no label). Labels that repeat a key with both values are
    left out. Work after the first aggregate is on strata x rules x cutoffs rows.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi").select("__key", (F.col("lo") == 1).alias("good"))
    s = F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")
    values = F.array(*[F.struct(F.lit(r).alias("rule"), F.least(F.lit(STEPS), F.ceil(STEPS * F.expr(x))).cast("int").alias("step")) for r, x in RULES.items()])
    rows = scored.where(~F.col("quality.base_failed")).select(F.col(key).alias("__key"), s, "quality.*").join(known, "__key").select("stratum", "good", F.inline(values))
    hist = written(rows.groupBy("stratum", "rule", "step").agg(F.sum(F.col("good").cast("bigint")).alias("good"), F.sum((~F.col("good")).cast("bigint")).alias("bad")), "histogram")
    tests = max(1, hist.select("stratum").distinct().count()) * len(RULES)
    group = Window.partitionBy("stratum", "rule")
    over = group.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    total = hist.withColumns({"n": F.sum("good").over(group), "m": F.sum("bad").over(group), "k": F.coalesce(F.sum("good").over(over), F.lit(0)), "r": F.coalesce(F.sum("bad").over(over), F.lit(0))})
    rate = alpha / len(RULES)
    # Beyond the expected number the bound can't hold at any level used here, so its sum is not built.
    p = F.when(F.col("k") > F.col("n") * rate, F.lit(1.0)).otherwise(upper_tail("n", "k", repr(rate)))
    tested = total.withColumn("ok", (F.col("n") > 0) & (p <= delta / tests))
    gain = F.col("r") / F.greatest(F.col("m"), F.lit(1)) - F.col("k") / F.greatest(F.col("n"), F.lit(1))
    best = tested.where("ok").withColumn("gain", gain).where("gain > 0.01").groupBy("stratum", "rule").agg(F.max(F.struct("gain", "step")).alias("b"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", (F.col("b.step") / STEPS).alias("cutoff")))).alias("cutoffs"))


def judge(scored: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """`scored` with `kept`: false where the base fails or a certified cutoff of the row's stratum is exceeded."""
    cutoffs = cutoffs.select(F.col("stratum").alias("__stratum"), F.col("cutoffs").alias("__cutoffs"))
    joined = scored.join(cutoffs, F.coalesce(F.col(stratum).cast("string"), F.lit("")) == F.col("__stratum"), "left")
    flat = joined.select("*", *[F.col(f"quality.{c}").alias(f"__{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_marks")])
    beyond = F.lit(False)
    for r, x in RULES.items():
        value = F.expr(re.sub(r"\b(n_\w+|word_chars)\b", r"__\1", x))
        beyond = beyond | F.coalesce(F.ceil(STEPS * value) > F.round(STEPS * F.col("__cutoffs")[r]), F.lit(False))
    return flat.select(*[c for c in scored.columns if c != "kept"], (~F.col("quality.base_failed") & ~beyond).alias("kept"))


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.1, stratum: str = "lang", key: str = "doc_id", text: str = "text", columns: bool = True) -> DataFrame:
    """All columns of docs (without `columns`, key and stratum), a struct `quality` (counts, base_failed) and `kept`.

    Null and empty texts have no words and fail the base. Null strata are one stratum.
    Without labels nothing is certified and only the base rejects. Repeated rows are
    judged alike. Columns named quality or kept are replaced. The counts are written once
    for the certification, never the texts; with `columns` they are counted again on the
    way to the result.
    """
    scored = written(counts(docs.select(key, stratum, text), text).drop(text), "quality")
    cutoffs = written(certify(scored, labels, alpha, delta, stratum, key), "cutoffs")
    return judge(counts(docs.drop("kept"), text) if columns else scored, cutoffs, stratum)
