"""Token operators against the libraries whose results they must give."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from loomrecord.llm.packing import OpenBins, pack, pieces
from loomrecord.llm.token_count import count_tokens, counter
from loomrecord.llm.tree_bpe import encode_decode, text_coder

ODD = [
    None, "", " ", "  ", "\n", " \n ", "a  b", "a   b\n\n c \n", "foo\n \nbar \n", "x<|endoftext|>y", "foo\n <|endoftext|>  bar<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40,
    "it's we'll I'd 'tis \t\r\n  end ", "日本語 テキスト　全角", "é‍👩‍👩‍👧 мир   x", "1234567890" * 50, " lead", "trail  ", "abab" * 300, "\x00\x1c \x85 z", "ß" * 500,
]


@pytest.fixture(scope="module")
def texts():
    rows = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id LIMIT 300").fetchall()]
    rnd = random.Random(5)
    pool = ["a", "b", " ", "  ", "\n", "\t", "'s", "ing", "Th", "9", "é", "…", "!!", "the", "世", "<|endoftext|>"]
    return ODD + rows + ["".join(rnd.choices(pool, k=rnd.randrange(80))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_match_library(texts, library):
    assert counter("byte_bpe_50k.json").count(texts) == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_tree_matches_library(texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = text_coder("byte_bpe_multi_50k.tiktoken")
    for t, got in zip(texts, coder.encode(texts)):
        assert got.tolist() == encoding.encode_ordinary(t or ""), t
        assert coder.coder.decode(got.tolist()) == (t or "").encode()
    rnd = random.Random(8)
    for _ in range(1500):  # every split point and depth, beyond what texts hold
        piece = bytes(rnd.choices(b"aabc eEtTh\xc3\xa9", k=rnd.randrange(1, 120)))
        assert coder.coder.tree(piece) == coder.coder.merge(piece)


def test_queries_on_odd_rows(spark, docs, library):
    rows = [*enumerate(ODD), (3, "again"), (3, "again"), (None, "no id")]
    got = count_tokens(docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=str) == sorted(
        ((i, len((t or "").encode()), n, n > 1024) for i, t in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)]), key=str)
    back = encode_decode(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in back) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    empty = docs([])
    assert count_tokens(empty).count() == encode_decode(empty).count() == pack(empty).count() == 0


def test_packing(spark, docs, texts, library):
    rows = [*enumerate(texts), (5, "twin"), (5, "twin"), (None, "no id"), (9999, " ".join(map(str, range(4000))))]
    got = pack(docs(rows), size=256, open_bins=16).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 256 + 1
        for p, s in enumerate([0, *range(first, len(ids), 256)]):
            part = ids[s:first if p == 0 else s + 256]
            want.append((str(i), p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len(bins) <= 1.1 * sum(w[3] for w in want) / 256 + 8
    assert pieces(docs([(1, "a " * 5000)])).count() > 1


def test_best_fit_against_plain_list():
    rnd = random.Random(3)
    bins, plain, made = OpenBins(100, 7), [], 0
    for _ in range(5000):
        n = rnd.randrange(1, 101)
        got = bins.put(n)
        fit = min((free for free, _ in plain if free >= n), default=None)
        if fit is None:
            item, made = (100, made), made + 1
        else:
            item = max((x for x in plain if x[0] == fit), key=lambda x: plain.index(x))
            plain.remove(item)
        assert got[1] == 100 - item[0]
        if fit is None:
            assert got[0] == item[1]
        item = (item[0] - n, got[0])
        if item[0]:
            if len(plain) == 7:
                fullest = min(plain)[0]
                if fullest >= item[0]:
                    continue
                plain.remove([x for x in plain if x[0] == fullest][-1])
            plain.append(item)
