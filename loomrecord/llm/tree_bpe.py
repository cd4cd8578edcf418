"""Byte-level BPE as a monoid: encode halves, join neighbours, decode up the tree.

Joining re-encodes a window around the seam. A sequence of tokens is the encoding of
its bytes exactly when each two neighbours are (the pair encodes to itself), so the
window need only grow until the pairs at its two edges are stable; tokens outside it
are then proven final.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from loomrecord.llm.common import ChunkCache, map_rows

LEAF = 4
NEVER = 1 << 40


class TreeCoder:
    def __init__(self, path: str, limit: int = 200_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.table = {i: t for t, i in self.ranks.items()}
        self.limit, self.stable_pairs, self.known = limit, {}, {}

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost of equals: the definition, on one short window."""
        ranks, n = self.ranks, len(piece)
        if n <= 24:
            parts = [piece[i:i + 1] for i in range(n)]
            pairs = [ranks.get(piece[i:i + 2], NEVER) for i in range(n - 1)]
            while pairs and (least := min(pairs)) < NEVER:
                i = pairs.index(least)
                parts[i] += parts.pop(i + 1)
                del pairs[i]
                if i:
                    pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
                if i < len(pairs):
                    pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
            return [ranks[x] for x in parts]
        nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(piece[i:end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if prev[i] >= 0 and (r := ranks.get(piece[prev[i]:stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        return [ranks[piece[i:end[i]]] for i in range(n) if alive[i]]

    def stable(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.stable_pairs.get(key)
        if known is None:
            if len(self.stable_pairs) > self.limit:
                self.stable_pairs.clear()
            known = self.stable_pairs[key] = self.merge(self.table[a] + self.table[b]) == [a, b]
        return known

    def join(self, x: list[int], y: list[int]) -> list[int]:
        """Encoding of the bytes of x followed by those of y, both encodings themselves."""
        if not x or not y:
            return x or y
        if self.stable(x[-1], y[0]):
            return x + y
        a = b = 1
        while True:
            window = self.merge(b"".join(map(self.table.__getitem__, x[len(x) - a:] + y[:b])))
            left = a == len(x) or self.stable(x[-a - 1], window[0])
            right = b == len(y) or self.stable(window[-1], y[b])
            if left and right:
                return x[:len(x) - a] + window + y[b:]
            a = a if left else min(len(x), 2 * a)
            b = b if right else min(len(y), 2 * b)

    def tree(self, piece: bytes) -> list[int]:
        known = self.known.get(piece)
        if known is not None:
            return known
        if len(piece) <= LEAF:
            done = self.merge(piece)
        else:
            # Cutting at a multiple of LEAF lets words share the subtrees of their beginnings.
            half = (len(piece) + 1) // (2 * LEAF) * LEAF or LEAF
            done = self.join(self.tree(piece[:half]), self.tree(piece[half:]))
        if len(piece) <= 4 * LEAF:
            if len(self.known) > 2 * self.limit:
                self.known.clear()
            self.known[piece] = done
        return done

    def encode(self, piece: bytes) -> list[int]:
        """One match of the pattern; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        return self.tree(piece) if whole is None else [whole]

    def decode(self, ids: list[int], block: int = 512) -> bytes:
        """Leaves are short blocks of ids; their bytes are joined pairwise up the tree."""
        level = [b"".join(map(self.table.__getitem__, ids[i:i + block])) for i in range(0, len(ids), block)]
        while len(level) > 1:
            level = [b"".join(level[i:i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


class TextCoder:
    """Whole texts to ids, each match of the pattern separately, without special tokens."""

    def __init__(self, name: str):
        self.coder = TreeCoder(public_tokenizers.path(name))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cache, self.pieces = ChunkCache(self._chunks, 300_000), {}

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Chunks differ mostly in punctuation, so the pattern's matches are remembered one by one."""
        known, find = self.pieces, self.pattern.findall
        if len(known) > self.cache.limit:
            known.clear()
        out = []
        for c in chunks:
            found = []
            for m in find(c):
                ids = known.get(m)
                if ids is None:
                    ids = known[m] = array("I", self.coder.encode(m.encode("utf-8"))).tobytes()
                found.append(ids)
            out.append(b"".join(found))
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if t and self.cache.safe(t)]
        done = dict(zip(plain, self.cache.values([texts[i] for i in plain])))
        return [np.frombuffer(b"".join(done[i]) if i in done else self._chunks([t or ""])[0], np.uint32) for i, t in enumerate(texts)]


@functools.lru_cache(maxsize=2)
def text_coder(name: str) -> TextCoder:
    return TextCoder(name)


def encode_decode(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (decoded bytes); with `ids`, the ids too.

    A null or empty text has no ids; both digests are then those of the empty string.
    One row per input row, repeated rows and null keys included; other columns are
    ignored. No shuffle.
    """
    def make():
        coder = text_coder(ranks)

        def run(keys, texts):
            encoded = [x.tolist() for x in coder.encode(texts)]
            out = {
                key: keys, "n_tokens": [len(x) for x in encoded],
                "ids_sha256": [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in encoded],
                "decoded_sha256": [hashlib.sha256(coder.coder.decode(x)).hexdigest() for x in encoded],
            }
            return out | ({"ids": encoded} if ids else {})
        return run
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>" if ids else "")
    return map_rows(docs, [key, text], schema, make)
