"""Repeated spans by suffix automata of reference shards.

Every window of WINDOW words picks its smallest k-word hash as anchor, so equal windows
pick equal anchors. Runs of windows around anchors that occur in several documents are
dealt by anchor into reference shards of bounded size; a shard's distinct runs form one
suffix automaton whose states carry the smallest document, the runs stream through it
for matching statistics, and windows matched in a smaller document are removed. The
reference is the corpus itself, so no automaton has a bound that would let it be
broadcast: shards and the runs that can match them meet by shuffle instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecord.llm.common import map_rows, words_of
from loomrecord.llm.shingles import mix, rolling, word_hashes

#: Words of an anchor.
ANCHOR = 5
#: Anchors in more documents than this are dealt by whole windows, so that no shard holds all their contexts.
HOT = 1000
#: Most keys over which the occurrences of one hot window are dealt.
SALTS = 64
#: Words and runs a task holds before it sends its distinct runs on.
HELD = 6_000_000
#: Bytes of a word's hash that runs carry; with the anchor, 64 bits of five of a window's words are equal besides.
WORD_BYTES = 5


class SuffixAutomaton:
    """Of several sequences; each state knows the smallest document in which its words occur."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def add(self, words: list[int], document: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w in words:
            p, q = last, nxt[last].get(w)
            if q is not None:
                if length[q] == length[p] + 1:
                    last = q
                else:
                    last = self._clone(p, q, w)
            else:
                cur = len(length)
                nxt.append({})
                link.append(0)
                length.append(length[p] + 1)
                first.append(None)
                while p != -1 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][w]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
                last = cur
            if first[last] is None or document < first[last]:
                first[last] = document

    def _clone(self, p: int, q: int, w: int) -> int:
        c = len(self.length)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(None)
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def finish(self) -> None:
        """Hand the smallest document down the suffix links, longest states first."""
        order = np.argsort(np.array(self.length), kind="stable")[::-1]
        first, link = self.first, self.link
        for s in order.tolist():
            p = link[s]
            if p > 0 and first[s] is not None and (first[p] is None or first[s] < first[p]):
                first[p] = first[s]

    def sources(self, words: list[int], window: int) -> list[int | None]:
        """By matching statistics: for each window of the words, the smallest document holding it (None: in none)."""
        nxt, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(w, 0)
            matched = matched + 1 if state else 0
            if i >= window - 1:
                if matched < window:
                    out.append(None)
                    continue
                while length[link[state]] >= window:
                    state = link[state]
                    matched = length[state]
                out.append(self.first[state])
        return out


def anchors(h: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of all texts: its first word's place, its anchor's place and hash; windows never cross texts."""
    grams = rolling(h, ANCHOR)
    width = window - ANCHOR + 1
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # The offset stands in the low bits: the least of a window then tells its place, ties being the leftmost.
    cut = grams & ~np.uint64(15)
    best = cut[:n].copy()
    for j in range(1, width):
        np.minimum(best, cut[j:j + n] | np.uint64(j), out=best)
    place = np.arange(n) + (best & np.uint64(15)).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    inside = np.arange(n) + window <= ends[:n]
    at = np.flatnonzero(inside)
    return at, place[at], grams[place[at]]


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc): the distinct anchors of each document."""
    def make():
        def run(keys, texts):
            h, offsets = word_hashes(texts)
            at, place, value = anchors(h, offsets, window)
            new = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, bool)
            owner = np.searchsorted(offsets, at[new], "right") - 1
            value = value[new]
            order = np.lexsort((value, owner))
            owner, value = owner[order], value[order]
            once = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])] if len(owner) else np.zeros(0, bool)
            return {"anchor": value[once].view(np.int64), "doc": np.array(keys, np.int64)[owner[once]]}
        return run
    return map_rows(docs, ["doc", "text"], "anchor bigint, doc bigint", make)


def _pack(words: np.ndarray) -> np.ndarray:
    """Five bytes of each word hash: what runs carry of their words."""
    return np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]


def _unpack(raw: bytes) -> list[int]:
    wide = np.zeros((len(raw) // WORD_BYTES, 8), np.uint8)
    wide[:, :WORD_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, WORD_BYTES)
    return wide.view(np.uint64)[:, 0].tolist()


def _found_runs(texts: list, found: pa.Array, salts: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """(key, digest, text, first word in the text, place in the hashes, words, salts) of the flagged runs of a batch, and the hashes."""
    h, offsets = word_hashes(texts)
    at, place, value = anchors(h, offsets, window)
    text = np.searchsorted(offsets, at, "right") - 1
    # Which windows carry an anchor that is flagged for their own text: a lookup of (text, anchor).
    flags = np.asarray(found.flatten()).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.asarray(found.value_lengths()))
    mine = flags ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(mine)
    wanted = value ^ mix(text.astype(np.uint64) + np.uint64(1))
    index = order[np.minimum(np.searchsorted(mine, wanted, sorter=order), len(mine) - 1)] if len(mine) else np.zeros(len(at), np.int64)
    hit = (mine[index] == wanted) & (flags[index] == value) & (owner[index] == text) if len(mine) else np.zeros(len(at), bool)
    parts = np.where(hit, np.asarray(salts.flatten())[index], 0) if len(mine) else np.zeros(len(at), np.int64)
    at, place, value, text, parts = (x[hit] for x in (at, place, value, text, parts))
    # A run: neighbouring windows with one anchor; of hot anchors, every window is a run.
    new = np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1) | (parts[1:] > 0)] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1 if len(at) else first
    grams = rolling(h, window)
    # At most `window` windows: the first and the last together are the whole run.
    digest = mix(grams[at[first]] * np.uint64(0x9E3779B97F4A7C15) + grams[at[last]] + (last - first).astype(np.uint64))
    key = np.where(parts[first] > 0, mix(grams[at[first]] + np.uint64(1)), value[first])
    return key, digest, text[first], at[first] - offsets[text[first]], at[first], at[last] - at[first] + window, parts[first], h


def _runs(flagged: DataFrame, window: int) -> DataFrame:
    """Runs of neighbouring windows that share a flagged anchor, by shard key; of hot anchors, each window by itself.

    Two kinds of rows: `words` with the smallest document a task has seen them in (once
    per task), and occurrences (doc, tag, starts) without words, one for each document
    and distinct run, however often it repeats there. Hot keys are salted: their
    occurrences are dealt over `salts` keys, their words go to each.
    """
    names = ["key", "digest", "doc", "tag", "starts", "words"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def contents() -> Iterator[pa.RecordBatch]:
            key, digest, doc, begin, length = (np.concatenate([x[i] for x in held]) for i in range(5))
            base = np.repeat(np.cumsum([0, *(len(x[5]) for x in held[:-1])]), [len(x[0]) for x in held])
            words = np.concatenate([x[5] for x in held])
            order = np.lexsort((doc, digest, key))
            key, digest, doc, begin, length = key[order], digest[order], doc[order], (begin + base)[order], length[order]
            once = np.r_[True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])] if len(key) else np.zeros(0, bool)
            key, digest, doc, begin, length = (x[once] for x in (key, digest, doc, begin, length))
            for a in range(0, len(key), 8192):
                part = slice(a, a + 8192)
                n = length[part]
                where = np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum(n * WORD_BYTES, out=offsets[1:])
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(words[where].tobytes())])
                nothing = (pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(digest[part].view(np.int64)), pa.array(doc[part]), *nothing, raw], names=names)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                docs, tags = (np.asarray(part.column(i)) for i in (0, 1))
                key, digest, text, start, begin, length, salts, h = _found_runs(part.column(2).to_pylist(), part.column(3), part.column(4), window)
                order = np.lexsort((start, digest, key, text))
                key, digest, text, start, begin, length, salts = (x[order] for x in (key, digest, text, start, begin, length, salts))
                once = np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])] if len(key) else np.zeros(0, bool)
                starts = pa.ListArray.from_arrays(pa.array(np.r_[np.flatnonzero(once), len(once)], pa.int32()), pa.array(start, pa.int64()))
                key, digest, text, begin, length, salts = (x[once] for x in (key, digest, text, begin, length, salts))
                doc = docs[text]
                salt = np.where(salts > 1, doc % np.maximum(salts, 1), 0)
                salted = lambda k, s: np.where(s > 0, mix(k + s.astype(np.uint64)), k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(salted(key, salt).view(np.int64)), pa.array(digest.view(np.int64)), pa.array(doc), pa.array(tags[text]), starts, pa.nulls(len(key), pa.binary())], names=names)
                copies = np.maximum(salts, 1)
                each = np.repeat(np.arange(len(key)), copies)
                salt = np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)
                held.append((salted(key[each], salt), digest[each], doc[each], begin[each], length[each], _pack(h)))
                size += len(h) + 4 * len(each)
                if size >= HELD:
                    yield from contents()
                    held, size = [], 0
        if held:
            yield from contents()
    return flagged.select("doc", "tag", "text", "found", "salts").mapInArrow(scan, "key bigint, digest bigint, doc bigint, tag bigint, starts array<bigint>, words binary")


def _matches(runs: DataFrame, window: int) -> DataFrame:
    """(doc, tag, starts, hit): occurrences with a window that a smaller document holds; hit has a bit for each such window.

    In each shard the words of a key come first and form its automaton; then its
    occurrences stream by, however many there are.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, {}, False
        for batch in batches:
            key, digest, doc, words = (batch.column(i).to_pylist() for i in (0, 1, 2, 5))
            rows, hits = [], []
            for i, (k, g, d, w) in enumerate(zip(key, digest, doc, words)):
                if k != at:
                    at, held, ready = k, {}, False
                if w is not None:
                    known = held.get(g)
                    if known is None or d < known[0]:
                        held[g] = (d, w)
                    continue
                if not ready:
                    ready = True
                    if len(held) == 1:  # one run alone: every window starts in its smallest document
                        held = {run: (least, (1 << len(raw) // WORD_BYTES - window + 1) - 1) for run, (least, raw) in held.items()}
                    else:
                        automaton = SuffixAutomaton()
                        lists = {run: _unpack(raw) for run, (_, raw) in held.items()}
                        for run, (least, _) in held.items():
                            automaton.add(lists[run], least)
                        automaton.finish()
                        held = {run: automaton.sources(lists[run], window) for run in lists}
                known = held[g]
                if type(known) is tuple:
                    hit = known[1] if known[0] < d else 0
                else:
                    hit = sum(1 << j for j, x in enumerate(known) if x < d)
                if hit:
                    rows.append(i)
                    hits.append(hit)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in (2, 3, 4)), pa.array(hits, pa.int64())], names=["doc", "tag", "starts", "hit"])
    dealt = runs.repartition("key").sortWithinPartitions("key", F.col("words").isNull())
    return dealt.mapInArrow(scan, "doc bigint, tag bigint, starts array<bigint>, hit bigint")


def _covered(n: int, starts: np.ndarray, hits: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that is hit; bit j of a hit is the window at start + j."""
    edge = np.zeros(n + 1, np.int64)
    while len(hits):
        at = starts[(hits & 1) == 1]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        more = hits > 1
        starts, hits = starts[more] + 1, hits[more] >> 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256; with keep_text, also kept_text and the removed spans (first word, end).

    A word goes if a window of `window` words covering it also starts in a row with a
    smaller key; windows are judged on the input. Null and empty texts have no words.
    Rows with equal keys are not each other's source, and rows with a null key are kept
    whole and are no source. Every row gives one row; extra columns are ignored.
    """
    docs = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text) if text == "text" else F.col(text).alias("text"), F.xxhash64(text).alias("tag"))
    known = docs.where(F.col("doc").isNotNull())
    # The filters spell out what a join infers, so that both uses of an exchange are the same plan and share it.
    rows = _anchor_rows(known, window).where(F.col("anchor").isNotNull() & F.col("doc").isNotNull()).repartition("anchor")
    repeated = rows.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    repeated = repeated.select("anchor", F.when(F.col("n") <= HOT, 0).otherwise(F.least(F.lit(SALTS), F.ceil(F.col("n") / (16 * HOT)))).cast("int").alias("salts"))
    flags = rows.join(repeated, "anchor").groupBy("doc").agg(F.collect_list(F.struct("anchor", "salts")).alias("f")).select("doc", F.col("f.anchor").alias("found"), F.col("f.salts").alias("salts"))
    hits = _matches(_runs(known.join(flags, "doc"), window), window)
    spans = hits.groupBy("doc").agg(F.collect_list(F.struct("tag", "starts", "hit")).alias("h"))

    kept_schema = f"`{key}` bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string, spans array<struct<first:bigint,end:bigint>>" if keep_text else "")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tag = np.asarray(batch.column(1))
            found = batch.column(3)
            flat = found.flatten()
            each = np.asarray(flat.field(1).value_lengths())
            tags, hits = (np.repeat(np.asarray(flat.field(i)), each) for i in (0, 2))
            starts = np.asarray(flat.field(1).flatten())
            bounds = np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(found.value_lengths().fill_null(0).to_numpy())]]
            out: list[list] = [[], [], [], [], []]
            for i, t in enumerate(batch.column(2).to_pylist()):
                words, part = words_of(t), slice(bounds[i], bounds[i + 1])
                own = tags[part] == tag[i]
                if own.any():
                    gone = _covered(len(words), starts[part][own], hits[part][own], window)
                    kept = b" ".join(compress(words, (~gone).tolist()))
                else:
                    gone, kept = np.zeros(len(words), bool), b" ".join(words)
                flips = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).tolist() if keep_text else []
                for col, x in zip(out, (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if keep_text else None, [{"first": a, "end": b} for a, b in zip(flips[::2], flips[1::2])])):
                    col.append(x)
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            names = [key, "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                arrays += [pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]
                names += ["kept_text", "spans"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    joined = known.join(spans, "doc", "left").unionByName(docs.where(F.col("doc").isNull()), allowMissingColumns=True)
    return joined.select("doc", "tag", "text", "h").mapInArrow(finish, kept_schema)
