"""Token counts by rank-synchronous merging of ragged numpy arrays.

Distinct pre-tokens of a batch lie one behind the other in one array of symbols. In
each round every sequence finds its own lowest-ranked pair, all its occurrences of that
pair merge at once, and the array is compacted. What survives is counted.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecord.llm.common import ChunkCache, map_rows

_NONE = np.int64(1) << 40


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeTable:
    """Merges of a byte-level vocabulary, looked up by pairs of symbol ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        model = json.load(open(path, encoding="utf-8"))
        vocab, letters = model["model"]["vocab"], _byte_letters()
        self.special = [t["content"] for t in model["added_tokens"]]
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.base = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.base[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left << 20 | right, kind="stable")
        self.keys, self.ranks = (left << 20 | right)[order], order.astype(np.int64)
        self.made = made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pieces when no pair can merge any more, and how many each piece has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.base[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[starts[1:] - 1] = _NONE
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            live = np.repeat(least < _NONE, sizes)
            done.append((symbols[~live], owner[~live]))  # finished sequences leave the arrays
            at = np.flatnonzero((rank == np.repeat(least, sizes)) & live)
            # Of equal symbols in a row ("aaa"), pairs are taken from the left without overlap.
            if len(at) > 1 and (np.diff(at) == 1).any():
                run = np.r_[True, np.diff(at) != 1]
                offset = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
                at = at[offset % 2 == 0]
            symbols[at] = self.made[rank[at]]
            live[at + 1] = False
            symbols, owner = symbols[live], owner[live]
        if not done:
            return symbols, lengths
        symbols, owner = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(pieces))


class TokenCounter:
    def __init__(self, name: str):
        self.table = MergeTable(public_tokenizers.path(name))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cache = ChunkCache(self._chunk_counts)

    def split(self, text: str) -> list[str]:
        if text.isascii() or max(text) < "ɐ":
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.table.splitter.pre_tokenize_str(text)]  # the library's own character classes

    def _chunk_counts(self, chunks: list[str]) -> list[int]:
        split = [self.split(c) for c in chunks]
        distinct = {p: i for i, p in enumerate({p for s in split for p in s})}
        counts = self.table.merge([p.encode() for p in distinct])[1].tolist() if distinct else []
        return [sum(counts[distinct[p]] for p in s) for s in split]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a special token's string counts as one token."""
        parts: list[str] = []
        owner: list[int] = []
        result = [0] * len(texts)
        for i, text in enumerate(texts):
            pieces = [text or ""]
            for s in self.table.special:
                if s in pieces[0] or len(pieces) > 1:
                    cut = [p.split(s) for p in pieces]
                    result[i] += sum(len(c) - 1 for c in cut)
                    pieces = [x for c in cut for x in c]
            for p in pieces:
                if not p:
                    continue
                if self.cache.safe(p):
                    parts.append(p)
                    owner.append(i)
                else:
                    result[i] += sum(self._chunk_counts([p]))
        for i, values in zip(owner, self.cache.values(parts)):
            result[i] += sum(values)
        return result


@functools.lru_cache(maxsize=2)
def counter(name: str) -> TokenCounter:
    return TokenCounter(name)


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty: no bytes, no tokens. Every row gives one row, so
    repeated rows and null keys stay; other columns are ignored. No shuffle; state per
    task is one batch and a bounded cache.
    """
    def make():
        coder = counter(tokenizer)

        def run(keys, texts):
            n = coder.count(texts)
            return {key: keys, "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}
        return run
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key), F.col(text)), [key, text], f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", make)
