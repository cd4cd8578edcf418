"""Benchmark passages against brute force over all windows."""

import hashlib
import random
import re

import pytest

from loomrecord.llm.decontaminate import SPAN, contamination

LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) if w]


def brute(rows, items):
    windows = {}
    for k, t in items:
        w = words(t)
        m = min(len(w), SPAN)
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add(k)
    out = []
    for k, t in rows:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[tuple(w[i:i + m])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((k, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [400_000, 0])
def test_contamination(spark, bound):
    rnd = random.Random(7)
    pool = ["ab", "Élan", "x9", "über", "STRASSE", "İx", "ß", "漢字", "q", "Ⅷ"]
    items = [(i, " ".join(rnd.choices(pool, k=rnd.randrange(1, 30)))) for i in range(2, 40)]
    items += [(100, "lone"), (101, "two words"), (102, None), (103, ""), (104, " ,;"), (2, "other words of item two"), (None, "nobody owns this one at all"), (105, items[5][1]), (11, "x " * 25)]
    rows = [(0, None), (1, ""), (2, "..."), (3, "Lone!"), (None, items[8][1]), (None, None), (4, "x " * 5000), (5, " ".join(rnd.choices(pool, k=9)))]
    for i in range(6, 90):
        t = []
        for _ in range(rnd.randrange(1, 5)):
            if rnd.random() < .4:
                w = words(rnd.choice(items)[1])
                a = rnd.randrange(len(w) + 1)
                t += [x.upper() if x.isascii() else x for x in w[a:a + rnd.randrange(5, 16)]]
            else:
                t += rnd.choices(["zz", "yy", *pool], k=rnd.randrange(12))
        rows.append((i, rnd.choice([" ", "--", ", \n"]).join(t)))
    rows += [rows[20], rows[20], (400, rows[21][1])]
    docs = spark.createDataFrame([(k, t, "en", 1, "z") for k, t in rows], "doc_id long, text string, lang string, n int, item_id string")
    table = spark.createDataFrame([(k, t, 5) for k, t in items], "item_id long, text string, doc_id int")
    got = contamination(docs, table, broadcast_windows=bound).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == brute(rows, items)
    assert all(len({j for s in r.spans for j in range(s.start, s.stop)}) == r.n_hit for r in got)
    assert contamination(docs.limit(0), table).count() == 0
    if bound:
        clean = contamination(docs, table.limit(0), broadcast_windows=bound).collect()
        assert len(clean) == len(rows) and not any(r.contaminated or r.n_items for r in clean)
