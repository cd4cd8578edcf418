"""Near-duplicate documents by b-bit MinHash.

Minima are taken over the whole shingle sets; bands of minima propose candidates, only
the low bits of each minimum are kept, and their agreement, corrected for chance
collisions, discards hopeless candidates by counting bits. What remains is confirmed on
the full sets. Buckets too large to be paired off are compared in blocks. Copies with equal sets collapse to one class before anything is paired.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecord.llm.common import map_rows, written
from loomrecord.llm.components import components
from loomrecord.llm.shingles import mix, rolling, word_hashes

#: Bands of BAND minima each; a pair at similarity 0.85 misses all of them with probability 4e-7, at 0.8 with 4e-5.
BANDS, BAND, MINIMA = 25, 5, 128
#: Low bits kept of each minimum, and the margin in standard deviations by which an estimate may fall short.
BITS, MARGIN = 2, 6.0
#: Buckets of more classes than this are not paired off: overlapping ones form crowds, compared block against block.
PAIRED = 64
#: Classes and shingles in one block of a crowd.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 300_000

_MULTIPLIERS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, A-Z lower-cased; shorter texts are one shingle, empty ones have none."""
    h, offsets = word_hashes(texts, lower=True)
    grams = rolling(h, words)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = b - a
        out.append(np.unique(grams[a:b - words + 1]) if n >= words else rolling(h[a:b], n) ^ np.uint64(n) if n else grams[:0])
    return out


def minima(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    best = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), block):
        np.minimum(best, (_MULTIPLIERS[:, None] * shingles[None, i:i + block]).min(1), out=best)
    return best


def signature(shingles: np.ndarray) -> tuple[list[int], list[int]]:
    """Band keys, and the low bits of the minima packed into 64-bit words."""
    low = minima(shingles)
    grid = low[:BANDS * BAND].reshape(BANDS, BAND)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
    per = 64 // BITS
    bits = ((low >> np.uint64(32)) & np.uint64((1 << BITS) - 1)).reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return key.view(np.int64).tolist(), np.bitwise_or.reduce(bits, 1).view(np.int64).tolist()


def _profiles(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    def make():
        def run(keys, tags, texts):
            sets = shingle_sets(texts, words)
            signed = [signature(s) if len(s) else (None, None) for s in sets]
            return {key: keys, "tag": tags, "n_shingles": [len(s) for s in sets], "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "bands": [b for b, _ in signed], "bits": [s for _, s in signed]}
        return run
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    return map_rows(rows, [key, "tag", "text"], f"`{key}` {kind}, tag bigint, n_shingles bigint, digest binary, bands array<bigint>, bits array<bigint>", make)


def _estimate(a: str, b: str) -> F.Column:
    """Estimated similarity: agreeing minima counted by bits, less what BITS agree by chance."""
    differ = F.lit(0)
    for i in range(MINIMA * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        any_bit = x
        for s in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(int(np.array([sum(1 << j for j in range(0, 64, BITS))], np.uint64).view(np.int64)[0]))))
    chance = 2.0 ** -BITS
    return ((1 - differ / F.lit(float(MINIMA))) - chance) / (1 - chance)


def _floor(percent: int) -> float:
    chance, p = 2.0 ** -BITS, percent / 100
    agree = chance + (1 - chance) * p
    return p - MARGIN * (agree * (1 - agree) / MINIMA) ** 0.5 / (1 - chance)


def _full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(digest, shingles) of the wanted classes, from the whole text of one representative each."""
    def make():
        def run(keys, texts, digests):
            out: dict[str, list] = {"digest": [], "shingles": []}
            for d, s in zip(digests, shingle_sets(texts, words)):
                if xxhash.xxh3_128_digest(s.tobytes()) == d:  # rows that repeat a key with another text are passed over
                    out["digest"].append(d)
                    out["shingles"].append(s.view(np.int64))
            return out
        return run
    rows = docs.select(F.col(key).alias("rep"), F.col(text).alias("text")).join(wanted, F.col("rep").eqNullSafe(F.col("first"))).select("rep", "text", "digest")
    return map_rows(rows, ["rep", "text", "digest"], "digest binary, shingles array<bigint>", make).dropDuplicates(["digest"])


def forest(digests: list[bytes], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, slab: int = 2048) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between the sets at `left` and those at `right`: all intersections, counted by matrix products."""
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[code] > 1  # shingles of one set alone add nothing
    _, code = np.unique(code[shared], return_inverse=True)
    owner = owner[shared]
    place = np.full(len(sets), -1)
    place[left] = np.arange(len(left))
    other = np.full(len(sets), -1)
    other[right] = np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, slab):
        a, b = np.searchsorted(code, (first, first + slab))
        x, y = np.zeros((len(left), slab), np.float32), np.zeros((len(right), slab), np.float32)
        c, o = code[a:b] - first, owner[a:b]
        mine, theirs = place[o] >= 0, other[o] >= 0
        x[place[o[mine]], c[mine]] = 1
        y[other[o[theirs]], c[theirs]] = 1
        common += x @ y.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
    root, out = list(range(len(sets))), []
    for i, j in zip(*(v.tolist() for v in np.nonzero(linked))):
        u, v = int(left[i]), int(right[j])
        ru, rv = u, v
        while root[ru] != ru:
            root[ru] = ru = root[root[ru]]
        while root[rv] != rv:
            root[rv] = rv = root[root[rv]]
        if ru != rv:
            root[max(ru, rv)] = min(ru, rv)
            out.append((digests[u], digests[v]))
    return out


def _crowd_links(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join each crowd's linked classes: every pair of blocks is compared in full, only forests leave a task."""
    shape = written(crowds.groupBy("crowd").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "blocks")
    rows = crowds.join(shape, "crowd").select("digest", "crowd", "blocks", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block"))
    each = rows.join(sets, "digest").select("digest", "shingles", "crowd", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    each = each.select("digest", "shingles", "block", "crowd", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        i, j, block = frame["i"].iloc[0], frame["j"].iloc[0], frame["block"].to_numpy()
        found = forest(frame["digest"].tolist(), [np.asarray(x, np.int64) for x in frame["shingles"]], np.flatnonzero(block == i), np.flatnonzero(block == j), percent)
        return pd.DataFrame(found, columns=["u", "v"])
    return each.groupBy("crowd", "i", "j").applyInPandas(compare, "u binary, v binary")


def _linked(docs: DataFrame, percent: int, words: int, key: str, text: str) -> DataFrame:
    """Per row: key, tag (hash of the text), n_shingles, root (one digest for each component; null without shingles), component_id."""
    floor = _floor(percent)
    rows = written(_profiles(docs, key, text, words), "profiles")
    classes = written(rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min(key).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "classes")
    banded = classes.select("digest", F.explode("bands").alias("band"))
    shared = written(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band"), "shared")
    members = written(banded.join(shared, "band"), "members")
    sizes = written(members.groupBy("band").agg(F.count("*").alias("n"), F.min("digest").alias("hub")), "sizes")
    placed = members.join(sizes, "band")
    small = placed.where(F.col("n") <= PAIRED).select("band", F.col("digest").alias("a"))
    pairs = small.join(small.select("band", F.col("a").alias("b")), "band").where("a < b").select("a", "b").distinct()
    side = lambda c: classes.select(F.col("digest").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").alias(f"n_{c}"))
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (_estimate("bits_a", "bits_b") >= floor)
    pairs = written(pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b", "n_a", "n_b"), "pairs")
    stars = placed.where((F.col("n") > PAIRED) & (F.col("digest") != F.col("hub"))).select(F.col("digest").alias("u"), F.col("hub").alias("v"))
    crowds = written(components(stars).select(F.col("node").alias("digest"), F.col("root").alias("crowd")).join(classes.select("digest", "n"), "digest"), "crowds")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).unionByName(crowds.select("digest")).distinct().join(classes.select("digest", "first"), "digest")
    sets = written(_full_sets(docs, wanted, key, text, words), "sets")
    common = F.size(F.array_intersect("sa", "sb"))
    sa, sb = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb"))
    confirmed = pairs.join(sa, "a").join(sb, "b").where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(confirmed.unionByName(_crowd_links(crowds, sets, percent))).select(F.col("node").alias("digest"), "root")
    named = classes.select("digest", "first").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    final = named.join(smallest, "root").select("digest", "root", "component_id")
    joined = rows.join(final, "digest", "left").withColumn("component_id", F.when(F.col("digest").isNull(), F.col(key)).otherwise(F.col("component_id")))
    return joined.select(key, "tag", "n_shingles", "root", "component_id")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable over links), kept (key = component_id).

    Links join texts with 100 * intersection >= percent * union of their shingle sets.
    Null, empty and blank texts have no shingles and are linked with nothing: each is its
    own component. Rows that repeat a key and differ in text count by text; a component
    takes the smallest key among its rows, nulls last, and a row with a null key is kept
    only where its whole component has none. Extra columns are ignored.
    """
    linked = _linked(docs, percent, words, key, text)
    return linked.select(key, "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, one row of each component: that of its smallest key (then text hash); nulls last.

    Rows equal in key and text become one. Rows without shingles are linked with nothing
    and all stay.
    """
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col("tag"))
    linked = _linked(docs, percent, words, key, text)
    best = linked.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(place).alias("p")).select(F.col("p.k").alias("__k"), F.col("p.tag").alias("__w")).distinct()
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    tagged = docs.withColumn("__tag", F.xxhash64(text))
    kept = tagged.where(worded).join(best, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__tag") == F.col("__w")), "left_semi")
    return kept.dropDuplicates([key, "__tag"]).drop("__tag").unionByName(docs.where(~worded))
