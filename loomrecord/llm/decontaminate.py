"""Benchmark passages in documents, by winnowing; DataFrame functions only.

A window is SPAN consecutive words of a benchmark item, or all words of a shorter item.
Both sides hash every GRAM words, keep the smallest hash inside each window and note
each stretch of windows that keep the same one as a single fingerprint. Equal windows
keep equal hashes, so every shared window shows up in the join of fingerprints. A hit
grows over the windows of its stretch, whose words are then compared in full.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.llm.common import written

SPAN = 10
GRAM = 4
#: Distinct benchmark windows (each about 150 bytes) up to which the tables of the benchmark are broadcast; beyond, the joins shuffle.
BROADCAST_WINDOWS = 400_000
#: What separates words: ASCII without 0-9, A-Z and a-z (fixed by the contract).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Beyond ASCII, what lower() could change.
CASED = r"[\x{80}-\x{10FFFF}&&[\p{IsUppercase}\p{IsTitlecase}]]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def item_words(text: Column) -> Column:
    """Words with A-Z lower-cased and nothing else changed; null text has none."""
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(CASED)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.coalesce(F.array_remove(F.split(low, SEPARATORS), ""), F.array().cast("array<string>"))


def _doubled(df: DataFrame, column: str, reach: int, pair) -> DataFrame:
    """Fold each element with the reach - 1 after it, in about log2(reach) passes over the array; the last ones fold what there is."""
    size = 1
    while size < reach:
        by = min(size, reach - size)
        df, size = df.withColumn(column, F.zip_with(column, F.slice(column, by + 1, F.size(column)), pair)), size + by
    return df


def with_fingerprints(df: DataFrame, spans: list[int]) -> DataFrame:
    """Add `prints`, an array of (span, first, end, hash): stretches of windows from first up to end that share their smallest gram hash.

    To be read by inline_outer: of a plain inline, Spark makes a filter that repeats all of this.
    """
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    for span in spans:
        gram = min(GRAM, span)
        df = _doubled(df.withColumn("kept", F.col("hashes")), "kept", gram, lambda a, b: F.xxhash64(a, b))
        df = _doubled(df, "kept", span - gram + 1, lambda a, b: F.least(a, b))
        df = df.withColumn("kept", F.slice("kept", 1, F.greatest(F.size("words") - span + 1, F.lit(0))))
        begins = F.transform("kept", lambda h, i: F.when((i == 0) | (h != F.get("kept", i - 1)), F.struct(i.alias("first"), h.alias("hash"))))
        df = df.withColumn("begins", F.filter(begins, lambda x: x.isNotNull())).withColumn(f"prints{span}", F.zip_with(
            "begins", F.slice("begins", 2, F.size("begins")), lambda a, b: F.struct(
                F.lit(span).alias("span"), a["first"].alias("first"), F.coalesce(b["first"], F.size("kept")).alias("end"), a["hash"].alias("hash"))))
    every = reduce(F.concat, [F.col(f"prints{s}") for s in spans])
    return df.withColumn("prints", every).drop("hashes", "kept", "begins", *[f"prints{s}" for s in spans])


def benchmark_tables(benchmark: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, list[int], int]:
    """(item and window, each once; distinct fingerprint hashes; spans that occur; number of distinct windows). Items without words have no window."""
    items = benchmark.select(F.col(key).cast("string").alias("item"), item_words(F.col(text)).alias("words")).where(F.size("words") > 0)
    span = F.least(F.size("words"), F.lit(SPAN))
    spans = sorted(r[0] for r in items.select(span.alias("span")).distinct().collect())  # at most SPAN values
    starts = items.select("item", "words", span.alias("span"), F.explode(F.sequence(F.lit(0), F.size("words") - span)).alias("at"))
    windows = written(starts.select("item", F.array_join(F.slice("words", F.col("at") + 1, F.col("span")), " ").alias("window")).distinct(), "windows")
    if not spans:
        return windows, windows.select(F.xxhash64("window").alias("hash")), [], 0
    own = with_fingerprints(items.select("words", span.alias("own")), spans).select("own", F.inline_outer("prints"))
    hashes = written(own.where("span = own").select("hash").distinct(), "hashes")
    return windows, hashes, spans, windows.select("window").distinct().count()


def _hits(base: DataFrame, hashes: DataFrame, small: bool) -> DataFrame:
    """(doc, tag, n, span, first, end, near): a row for each stretch whose hash the benchmark has, with the words around it, and one with span 0 for each row of base."""
    around = F.slice("words", F.col("first") + 1, F.greatest(F.col("end") - F.col("first") - 1 + F.col("span"), F.lit(0))).alias("near")
    mark = F.struct(F.lit(0).alias("span"), F.lit(0).alias("first"), F.lit(1).alias("end"), F.col("tag").alias("hash"))
    if small:
        rows = base.select("doc", "tag", F.size("words").alias("n"), "words", F.inline_outer(F.concat("prints", F.array(mark))))
        rows = rows.join(F.broadcast(hashes.withColumn("known", F.lit(True))), "hash", "left").where("span = 0 OR known")
        return rows.select("doc", "tag", "n", "span", "first", "end", around)
    # Fingerprints travel without the words, and those that are known go back to their documents.
    found = base.select("doc", "tag", F.inline_outer("prints")).join(hashes, "hash").groupBy("doc", "tag").agg(F.collect_set(F.struct("span", "first", "end")).alias("found"))
    found = found.select(F.col("doc").alias("d"), F.col("tag").alias("t"), "found")
    back = base.select("doc", "tag", "words").join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    none = F.array().cast("array<struct<span:int,first:int,end:int>>")
    rows = back.select("doc", "tag", F.size("words").alias("n"), "words", F.inline_outer(F.concat(F.coalesce("found", none), F.array(mark.dropFields("hash")))))
    return rows.select("doc", "tag", "n", "span", "first", "end", around)


def _covered(spans: Column) -> Column:
    """Places that lie in any of the (start, stop)."""
    zero = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("bigint").alias("n"))
    grown = lambda a, x: F.struct(F.greatest(a["stop"], x["stop"]).alias("stop"), (a["n"] + F.greatest(x["stop"] - F.greatest(a["stop"], x["start"]), F.lit(0))).alias("n"))
    return F.aggregate(F.sort_array(spans), zero, grown, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row of docs: key, n_words, n_hit, n_items, items_sha256, contaminated, spans (start, stop of each hit window).

    A word is hit when it lies in an occurrence of a window. Null and empty texts have no
    words; an empty benchmark hits nothing. Items without an id hit words but are not
    listed; items of one id are one; repeated rows of docs, null keys too, come out
    as often as they went in. Other columns on either side are ignored. All words of
    all texts count. Benchmark tables are broadcast up to `broadcast_windows` distinct
    windows, and shuffled beyond.
    """
    windows, hashes, spans, n_windows = benchmark_tables(benchmark, item_key, item_text)
    small = n_windows <= broadcast_windows
    base = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("tag"), item_words(F.col(text)).alias("words"))
    none = F.array().cast("array<struct<span:int,first:int,end:int,hash:bigint>>")
    base = with_fingerprints(base, spans) if spans else base.withColumn("prints", none)
    near = _hits(base, hashes, small)
    at = near.select("doc", "tag", "n", "span", "first", "near", F.explode(F.sequence(F.lit(0), F.col("end") - F.col("first") - 1)).alias("at"))
    marked = F.when(F.col("span") > 0, F.array_join(F.slice("near", F.col("at") + 1, F.col("span")), " "))
    # Rows that mark a document keep a key of their own in the join, so that no task gets them all.
    tried = at.select("doc", "tag", "n", "span", (F.col("first") + F.col("at")).alias("start"), F.coalesce(marked, F.concat(F.lit(" "), F.col("tag"))).alias("window"))
    known = windows.select("window").distinct().withColumn("id", F.md5("window"))
    tried = tried.join(F.broadcast(known) if small else known, "window", "left").where("span = 0 OR id IS NOT NULL")
    place = F.when(F.col("span") > 0, F.struct("start", (F.col("start") + F.col("span")).alias("stop")))
    per = tried.groupBy("doc", "tag").agg(F.max("n").cast("bigint").alias("n_words"), F.count_if(F.col("span") == 0).alias("rows"), F.collect_set(place).alias("spans"), F.sort_array(F.collect_set("id")).alias("ids"))
    per = written(per, "hits")
    # One list of items for each distinct set of windows, however many documents have it.
    lists = per.where(F.size("ids") > 0).select("ids").distinct()
    lists = lists.select("ids", F.explode("ids").alias("id")).join(windows.select(F.md5("window").alias("id"), "item"), "id")
    lists = lists.groupBy("ids").agg(F.sort_array(F.collect_set("item")).alias("items")).select("ids", F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ",").alias("joined"))
    hit = per.where(F.size("ids") > 0).join(lists, "ids")
    clean = per.where(F.size("ids") == 0).withColumns({"n_items": F.lit(0).cast("bigint"), "joined": F.lit("")})
    step = 65_536  # a row that came often is given back in pieces of so many
    done = hit.unionByName(clean).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / step))))
    done = done.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.least(F.lit(step), F.col("rows") - F.col("piece") * step).cast("int"))))
    n_hit = _covered(F.col("spans"))
    return done.select(F.col("doc").alias(key), "n_words", n_hit.alias("n_hit"), "n_items", F.sha2(F.col("joined").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.sort_array("spans").alias("spans"))
