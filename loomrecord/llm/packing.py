"""Bounded-space online best-fit packing of token sequences.

Texts become ids, ids become pieces, and each shuffle partition packs its stream of
piece lengths: at most `open_bins` sequences are open, a bitset has a bit for each free
space that some open sequence offers, the least sufficient one takes the piece, and
when the bound is reached the fullest sequence closes first.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecord.llm.common import map_rows
from loomrecord.llm.token_count import _NONE as NO_MERGE, MergeTable, counter

END = b"\0\0\0\0"
#: Beyond Latin, the library's own character classes decide (as token_count.TokenCounter.split).
_FAR = re.compile("[\u0250-\U0010ffff]")
#: Characters without or of white space in a row that make a very long piece.
LONG = 1000
_BLANK = re.compile(rf"\s{{{LONG}}}")


def has_long_piece(text: str) -> bool:
    """Whether LONG characters may stand together: half as many without a space, at the same places of any text, or a run of white space."""
    half = LONG // 2
    return len(text) >= LONG and (any(text.find(" ", i, i + half) < 0 for i in range(0, len(text) - half, half)) or _BLANK.search(text) is not None)


class OpenBins:
    """Open sequences by free space, found with a bitset."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.free, self.bits, self.open, self.made = size, most, {}, 0, 0, 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        chosen = bins.pop()
        if not bins:
            self.bits ^= 1 << space
        self.open -= 1
        return chosen

    def put(self, length: int) -> tuple[int, int]:
        """The piece's sequence and its offset there."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(space)
        else:
            chosen, space = self.made, self.size
            self.made += 1
        left = space - length
        if left:
            if self.open == self.most:  # the fullest closes, be it the one in hand
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest < left:
                    self._take(fullest)
                else:
                    return chosen, self.size - space
            self.free.setdefault(left, []).append(chosen)
            self.bits |= 1 << left
            self.open += 1
        return chosen, self.size - space


class HashedMerges(MergeTable):
    """Merges found by open addressing instead of bisection."""

    BITS = 19
    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        super().__init__(path)
        bits = max(self.BITS, int(8 * len(self.keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.found = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_MERGE, np.int64)
        left, step = np.arange(len(self.keys)), 0
        while len(left):  # all at once: the first of those that meet in a free slot gets it, the others go on
            at = (self._home(self.keys[left]) + step) & self.mask
            free = np.flatnonzero(self.slots[at] == -1)
            at, first = np.unique(at[free], return_index=True)
            taken = left[free[first]]
            self.slots[at], self.found[at] = self.keys[taken], self.ranks[taken]
            left, step = np.setdiff1d(left, taken), step + 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * self.STEP >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = self._home(key)
        held = self.slots[at]
        out = np.where(held == key, self.found[at], NO_MERGE)
        todo = np.flatnonzero((held != key) & (held != -1))
        at = at[todo]
        while len(todo):
            at = at + 1 & self.mask
            held = self.slots[at]
            hit = held == key[todo]
            out[todo[hit]] = self.found[at[hit]]
            on = ~hit & (held != -1)
            todo, at = todo[on], at[on]
        return out


class IdBytes:
    """Texts to little-endian 32-bit ids, as the tokenizers library gives them.

    Where ids rise in the order of the merges, the tiktoken library gives the same ids
    sooner; it gets the texts for which both libraries' patterns agree. The tokenizers
    library encodes the others: those with characters beyond Latin, with a special
    token's string, or with very long pieces.
    """

    def __init__(self, name: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.counter = Tokenizer.from_file(public_tokenizers.path(name)), counter(name)
        self.table, self.special, self.limit = HashedMerges(public_tokenizers.path(name)), self.counter.table.special, limit
        self.pieces, self.fast = {}, self._by_rank(name)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id, from the bytes of the two that it merges."""
        table = self.table
        out = [b""] * (int(max(table.made.max(), table.base.max())) + 1)
        for i, token in enumerate(table.base.tolist()):
            out[token] = bytes([i])
        order = np.argsort(table.ranks, kind="stable")
        for key, made in zip(table.keys[order].tolist(), table.made.tolist()):
            out[made] = out[key >> 20] + out[key & (1 << 20) - 1]
        return out

    def _by_rank(self, name: str):
        import tiktoken

        if (np.diff(self.table.made) <= 0).any() or self.table.base.max() >= self.table.made.min():
            return None
        ranks = {token: i for i, token in enumerate(self.token_bytes()) if token}
        return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of parts of texts, special tokens' strings taken as plain text; the pattern's matches are remembered."""
        known = self.pieces
        if len(known) > self.limit:
            known.clear()
        near = _FAR.search("".join(chunks)) is None  # then the pattern's classes are the library's
        split = list(map(self.counter.pattern.findall, chunks)) if near else [self.counter.split(c) if c else [] for c in chunks]
        new = list(set().union(*split).difference(known))
        if new:
            symbols, sizes = self.table.merge([p.encode() for p in new])
            flat, ends = symbols.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            known.update((p, flat[a:b]) for p, a, b in zip(new, [0, *ends], ends))
        get = known.__getitem__
        return [get(s[0]) if len(s) == 1 else b"".join(map(get, s)) for s in split]

    def _one(self, text: str) -> bytes:
        odd = self.fast is None or any(s in text for s in self.special) or _FAR.search(text) or has_long_piece(text)
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if odd else self.fast.encode_to_numpy(text)
        return np.asarray(ids, "<u4").tobytes()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        return [self._one(t) if t else b"" for t in texts]


@functools.lru_cache(maxsize=2)
def id_bytes(name: str) -> IdBytes:
    return IdBytes(name)


def pieces(docs: DataFrame, size: int = 2048, tokenizer: str = "byte_bpe_50k.json", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32): ids plus one end id 0, cut only where longer than `size`; the first piece takes the remainder."""
    def make():
        coder = id_bytes(tokenizer)

        def run(keys, texts):
            out: dict[str, list] = {key: [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for k, ids in zip(keys, coder.ids(texts)):
                ids += END
                n = len(ids) // 4
                first = (n - 1) % size + 1
                for p, start in enumerate([0, *range(first, n, size)]):
                    stop = first if p == 0 else start + size
                    for name, value in zip(out, (k, p, start, stop - start, zlib.crc32(ids[4 * start:4 * stop]))):
                        out[name].append(value)
            return out
        return run
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", make)


def pack(docs: DataFrame, size: int = 2048, open_bins: int = 512, tokenizer: str = "byte_bpe_50k.json", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and is its end id alone. Repeated rows are packed each by itself,
    null keys too. Only piece rows are shuffled (no ids), so partitions are large and
    few sequences end part-filled; sequence_id holds the partition in its high bits. The
    stream's order is fixed by key and content, so a repeated task packs alike.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, part = OpenBins(size, open_bins), TaskContext.get().partitionId() << 40
        for frame in frames:
            placed = [bins.put(n) for n in frame["length"].tolist()]
            yield frame.assign(sequence_id=[part + s for s, _ in placed], offset=[o for _, o in placed])
    found = pieces(docs, size, tokenizer, text, key)
    spread = F.xxhash64(key, "piece", "ids_crc32")
    kind = docs.schema[key].dataType.simpleString()
    return found.repartition(spread).sortWithinPartitions(spread, key, "piece", "ids_crc32").mapInPandas(
        run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
