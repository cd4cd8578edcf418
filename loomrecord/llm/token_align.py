"""Alignment of two tokenizers by merging the ends of their tokens, cut by merge paths.

The ends of A's and of B's tokens are two rising sequences. Each distinct end closes a
stretch of bytes inside one A token and one B token, so merging the ends gives every
overlapping pair once, and ends that both have close a group. Diagonals of the merge
grid, found by binary search, cut the merge into pieces of equal work that know nothing
of one another; where a shared end falls on a cut, the neighbours are stitched.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import compress

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecord.llm.common import ChunkCache, map_rows, written
from loomrecord.llm.packing import IdBytes

SHIFT = 20
#: Distinct id pairs (16 bytes and a hash slot each) up to which their counts are broadcast; beyond, the join shuffles.
BROADCAST_PAIRS = 2_000_000


def diagonals(ea: np.ndarray, eb: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) at each multiple of `work` merged ends: how many of A and of B come before, A first where both end."""
    d = np.append(np.arange(0, len(ea) + len(eb), work), len(ea) + len(eb))
    low, high = np.maximum(0, d - len(eb)), np.minimum(d, len(ea))
    while (low < high).any():
        mid = (low + high) // 2
        live = low < high
        # One more of A belongs before the cut if it ends no later than the last of B before it.
        more = np.zeros(len(d), bool)
        more[live] = ea[mid[live]] <= eb[d[live] - mid[live] - 1]
        low, high = np.where(live & more, mid + 1, low), np.where(live & ~more, mid, high)
    return low, d - low


def overlaps(ea: np.ndarray, eb: np.ndarray, work: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A's token, B's token, whether both end there) for each distinct end, in order; both sequences rise strictly and end alike."""
    at_a, at_b = diagonals(ea, eb, work)
    ends, a, b, shared = [], [], [], []
    for i, i2, j, j2 in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]):
        own_a, own_b = ea[i:i2], eb[j:j2]
        e = np.concatenate((own_a, own_b))
        e.sort(kind="stable")
        twice = np.zeros(len(e), bool)
        twice[:-1] = e[:-1] == e[1:]
        first = np.ones(len(e), bool)
        first[1:] = ~twice[:-1]
        e, twice = e[first], twice[first]
        if ends and len(e) and ends[-1][-1] == e[0]:  # A's end closed the piece before, B's equal one opens this
            shared[-1][-1] = True
            e, twice = e[1:], twice[1:]
        if len(e):
            ends.append(e)
            shared.append(twice)
            a.append(i + np.searchsorted(own_a, e))
            b.append(j + np.searchsorted(own_b, e))
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(a), np.concatenate(b), np.concatenate(shared)


class Aligner:
    """Texts to token pairs and groups. Texts are taken apart at single spaces, where tokens of both kinds end, and each distinct part is aligned once."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a, self.b = IdBytes(a), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        self.bytes_a = self.a.token_bytes()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # No piece joins a character to a space after it, so none reaches over a single space.
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.names_a, self.names_b = ([str(i) for i in range(len(t))] for t in (self.bytes_a, self.bytes_b))
        self.cache = ChunkCache(self.units, 250_000)

    def units(self, texts: list[str]) -> list[tuple | None]:
        """Of each text, which starts with the space that B adds by itself: (pairs, groups as text, A tokens, B tokens, groups); None where bytes differ."""
        ids_a = [np.frombuffer(x, "<u4") for x in self.a._chunks(texts)]
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        get_a, get_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        same = [b"".join(map(get_a, x.tolist())) == (raw := t.encode("utf-8")) and b"".join(map(get_b, y)) == raw and bool(raw) for t, x, y in zip(texts, ids_a, ids_b)]
        ids_a, ids_b = list(compress(ids_a, same)), list(compress(ids_b, same))
        if not ids_a:
            return [None] * len(texts)
        n_a, n_b = (np.array([len(x) for x in ids]) for ids in (ids_a, ids_b))
        flat_a = np.concatenate(ids_a).astype(np.int64)
        flat_b = np.fromiter((i for x in ids_b for i in x), np.int64, n_b.sum())
        a, b, shared = overlaps(np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b]))
        pairs = flat_a[a] << SHIFT | flat_b[b]
        cut_a, cut_b = [0, *(a[shared] + 1).tolist()], [0, *(b[shared] + 1).tolist()]
        last = np.cumsum(n_a) - 1  # each unit ends where both end
        links = np.searchsorted(a, last, "right")
        groups = np.cumsum(shared)[links - 1].tolist()
        names_a, names_b = [self.names_a[i] for i in flat_a.tolist()], [self.names_b[i] for i in flat_b.tolist()]
        written_out = [",".join(names_a[p:q]) + "|" + ",".join(names_b[r:s]) for p, q, r, s in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        raw, out, p, g = pairs.tobytes(), [], 0, 0
        for q, h, x, y in zip(links.tolist(), groups, n_a.tolist(), n_b.tolist()):
            out.append((raw[8 * p:8 * q], ";".join(written_out[g:h]), x, y, h - g))
            p, g = q, h
        found = iter(out)
        return [next(found) if s else None for s in same]

    def align(self, texts: list[str | None]) -> list[list]:
        """The units of each text, one after another; None where there are no tokens."""
        whole = [" " + t if t else None for t in texts]
        parted = [i for i, t in enumerate(whole) if t and self.apart and "  " not in t and t[-1] != " " and "▁" not in t and self.cache.safe(t)]
        done = dict(zip(parted, self.cache.values([whole[i] for i in parted])))
        rest = [i for i, t in enumerate(whole) if t and i not in done]
        done |= {i: ["", u] for i, u in zip(rest, self.units([whole[i] for i in rest]))} if rest else {}
        found = [done[i][1:] if i in done else [None] for i in range(len(texts))]  # before the first space lies nothing
        return [None if None in u else u for u in found]


@functools.lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def alignments(docs: DataFrame, a: str, b: str, key: str, text: str) -> DataFrame:
    """Per row: a number of its own, key, counts, digest of the groups, distinct pairs and how often each is linked."""
    def make():
        coder, count = aligner(a, b), iter(range(1 << 40))
        part = TaskContext.get().partitionId() << 40

        def run(keys, texts):
            out: dict[str, list] = {c: [] for c in ("row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")}
            for k, units in zip(keys, coder.align(texts)):
                raw, groups, n_a, n_b, n_groups = zip(*units) if units else ((), (), (), (), ())
                links = np.frombuffer(b"".join(raw), np.int64)
                pairs, times = np.unique(links, return_counts=True)
                digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if units else ""
                for c, v in zip(out.values(), (part + next(count), k, sum(n_a), sum(n_b), sum(n_groups), len(links), digest, pairs, times)):
                    c.append(v)
            return out
        return run
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_rows(rows, ["key", "text"], f"row bigint, key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>", make, 128)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best) over the corpus; best: no other pair of its B id is linked more often."""
    counts = found.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    counts = written(counts.withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1)), "pairs")
    return counts.join(counts.groupBy("b").agg(F.max("count").alias("most")), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", text: str = "text", key: str = "doc_id", broadcast_pairs: int = BROADCAST_PAIRS, salts: int = 16) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text (it adds the space); special tokens'
    strings are plain text. Texts that are null or empty, or whose tokens do not spell
    the same bytes, have no tokens: zeros and an empty digest column. Repeated rows and
    null keys each give their row and count in the corpus; other columns are ignored.
    Counts cover all rows. Alignments are written once and read twice, never made anew.
    """
    found = written(alignments(docs, a, b, key, text), "alignments")
    counts = pair_counts(found)
    links = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).select("row", F.col("pairs").alias("pair"), "times")
    if counts.count() <= broadcast_pairs:
        links = links.join(F.broadcast(counts), "pair")
    else:  # a pair that nearly every document has is dealt over several tasks
        dealt = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        links = links.withColumn("salt", F.pmod("row", F.lit(salts))).join(dealt, ["pair", "salt"])
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    rows = found.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
