"""Substring and near duplicates against brute force on small tables."""

import hashlib
import itertools
import random

import pytest

from loomrecord.llm import near_dedup, substring_dedup
from loomrecord.llm.components import components
from loomrecord.llm.near_dedup import near_duplicates, shingle_sets
from loomrecord.llm.substring_dedup import SuffixAutomaton, remove_repeats


def brute_removed(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[j:j + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j:j + window])] < i:
                gone[j:j + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120, vocabulary=60):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") * rnd.randrange(1, 1 + vocabulary // 10)
    passages = [[word() for _ in range(rnd.randrange(10, 60))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one two three"), (None, " ".join(passages[0] * 2)), (5, " ".join(passages[1]))]
    for i in range(6, n):
        w = []
        for _ in range(rnd.randrange(1, 5)):
            w += rnd.choice(passages) if rnd.random() < .5 else [word() for _ in range(rnd.randrange(30))]
        if rnd.random() < .3:
            w = rows[rnd.randrange(len(rows))][1] and rows[rnd.randrange(5, len(rows))][1].split() or w
            if w and rnd.random() < .5:
                w[rnd.randrange(len(w))] = "edit"
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(w)))
    rows += [(n + i, " ".join([rnd.choice(["ja ", "nein "]) * rnd.randrange(10, 90), word()])) for i in range(6)]  # one word over and over
    return rows + [(7, rows[7][1]), (7, "other text " + " ".join(passages[2]))]


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeated_spans(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = corpus(1)
    got = remove_repeats(docs(rows), window=13).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_removed(rows, 13)
    if hot == 1:
        kept = remove_repeats(docs(rows), keep_text=True).collect()
        assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and sum(s.end - s.first for s in r.spans) == r.n_removed for r in kept)
        assert remove_repeats(docs([])).count() == 0


def test_automaton():
    rnd = random.Random(4)
    for _ in range(60):
        seqs = [([rnd.randrange(3) for _ in range(rnd.randrange(1, 25))], rnd.randrange(9)) for _ in range(6)]
        a = SuffixAutomaton()
        for s, d in seqs:
            a.add(s, d)
        a.finish()
        probe = [rnd.randrange(3) for _ in range(40)]
        for w in (1, 3, 5):
            want = [min((d for s, d in seqs for k in range(len(s) - w + 1) if s[k:k + w] == probe[j:j + w]), default=None) for j in range(40 - w + 1)]
            assert a.sources(probe, w) == want


def brute_near(rows, percent, words=5):
    sets = [set(x.tolist()) for x in shingle_sets([t for _, t in rows], words)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    out = []
    for i, (k, _) in enumerate(rows):
        mine = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [k]
        c = min(mine) if mine and mine[0] is not None else None
        out.append((k, len(sets[i]), c, k == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("paired", [64, 2])
def test_near_duplicates(spark, docs, monkeypatch, paired):
    monkeypatch.setattr(near_dedup, "PAIRED", paired)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 5)
    rnd = random.Random(7)
    rows = [(0, None), (1, ""), (2, "A b"), (3, "a B"), (4, "a b c d e"), (None, "null id text here"), (6, "null ID text here"), (None, None), (8, "same key"), (8, "same key other text")]
    for f in range(5):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(30, 200))]
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randrange(6)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9)}"
            rows.append((rnd.randrange(10_000), " ".join(w)))
            base = w if rnd.random() < .5 else base
    got = near_duplicates(docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute_near(rows, 85)
    if paired == 64:
        assert near_duplicates(docs([])).count() == near_duplicates(docs([(1, None)])).where("kept").count() - 1 == 0


def test_components_of_chains(spark):
    rnd = random.Random(2)
    names = rnd.sample(range(1000), 300)
    edges = [(names[i], names[i + 1]) for i in range(0, 299) if i % 60 != 59] + [(5000, 5000), (1, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for s in range(0, 300, 60):
        assert {got[x] for x in names[s:s + 60]} == {min(names[s:s + 60])}
