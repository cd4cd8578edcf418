"""Alignment against a plain walk over both libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from loomrecord.llm.token_align import align_tokenizers, diagonals, overlaps


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    links, out, total = [], [], Counter()
    for k, t in rows:
        ia = a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        sa = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
        sb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or b"".join(sa) != (" " + t).encode() or b"".join(sb) != (" " + t).encode():
            links.append(Counter())
            out.append((k, 0, 0, 0, 0, ""))
            continue
        ea, eb = np.cumsum([len(x) for x in sa]).tolist(), np.cumsum([len(x) for x in sb]).tolist()
        mine, i, j = Counter(), 0, 0
        while i < len(ia):
            mine[ia[i], ib[j]] += 1
            x, y = ea[i], eb[j]
            i, j = i + (x <= y), j + (y <= x)
        groups, ga, gb, cuts = [], [], [], set(ea) & set(eb)
        by_a, by_b = defaultdict(list), defaultdict(list)
        edges = sorted(cuts)
        for ids, ends, to in ((ia, ea, by_a), (ib, eb, by_b)):
            for x, e in zip(ids, ends):
                to[next(c for c in edges[np.searchsorted(edges, e):])].append(str(x))
        groups = [",".join(by_a[c]) + "|" + ",".join(by_b[c]) for c in edges]
        links.append(mine)
        total += mine
        out.append((k, len(ia), len(ib), len(groups), sum(mine.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    full = [(*o[:5], sum(n for p, n in m.items() if total[p] == most[p[1]]), sum(n * total[p] for p, n in m.items()), o[5]) for o, m in zip(out, links)]
    return sorted(full, key=str)


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_alignment(spark, docs, bound):
    rnd = random.Random(5)
    odd = [None, "", " ", "a", "  two  spaces ", " lead", "trail ", "x▁y", "<|endoftext|> and <s> </s> <0x0A>", "a\nb\r\n\tc \n d", "é ﬁ Å １ ß 漢字 𝄞", " nb sp  em", "don't we'll I'M", "\x00nul \x07", "é combining", "word " * 3000 + "end", "　", "1234567 890"]
    parts = ["The", "theron", "heshinan,", "über", "\n", "x" * 40, "naïve.", "12.5%", "Ωmega", "don't", "(yes)", "http://a.b/c?d=1", "漢字かな"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + i, " ".join(rnd.choices(parts, k=rnd.randrange(1, 60)))) for i in range(60)] + [(None, "a null key"), (100, "again"), (3, "a"), (3, "a")]
    got = align_tokenizers(docs(rows), broadcast_pairs=bound, salts=3).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert align_tokenizers(docs([])).count() == 0


@pytest.mark.parametrize("work", [1, 2, 3, 7, 1000])
def test_merge_path(work):
    rnd = random.Random(work)
    for _ in range(60):
        end = rnd.randrange(1, 60)
        ea, eb = (np.array(sorted({*rnd.sample(range(1, end + 1), rnd.randrange(end)), end})) for _ in range(2))
        i, j = diagonals(ea, eb, work)
        assert ((i + j)[:-1] == np.arange(0, len(ea) + len(eb), work)).all() and (i[-1], j[-1]) == (len(ea), len(eb))
        a, b, shared = overlaps(ea, eb, work)
        spans = lambda e: list(zip([0, *e[:-1].tolist()], e.tolist()))
        want = [(x, y) for x, (s, e) in enumerate(spans(ea)) for y, (p, q) in enumerate(spans(eb)) if max(s, p) < min(e, q)]
        assert sorted(zip(a.tolist(), b.tolist())) == want and shared.sum() == len(set(ea.tolist()) & set(eb.tolist()))
