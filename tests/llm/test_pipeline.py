"""The pipeline against its stages worked out in plain Python, each on its own input."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from loomrecord.llm.common import written
from tests.llm.test_lines_rules import brute_counts, brute_lines
from tests.llm.test_pii import brute
from tests.llm.test_repeats import brute_near


def fixture(rnd):
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, texts = line(60), []
    for i in range(40):
        texts.append("\n".join([line(30), line(40), *([passage] if i % 4 == 0 else []), f"{word()} mail{i}@x.org {word()} +1 (017) 555-77{i % 10}3 " + line(12)]))
    texts += [texts[3], texts[3], texts[5] + " end", line(20), None, "", "!! ", texts[1].replace("mail", "post"), line(900)]
    near = line(200).split()
    for _ in range(5):
        w = list(near)
        w[rnd.randrange(200)] = word()
        texts.append(" ".join(w))
    return [(i, t) for i, t in enumerate(texts)]


def redacted(text):
    spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in brute(text)))
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_pipeline(spark, tmp_path):
    rows = fixture(random.Random(11))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = rows
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == cp.COLUMNS
        if name == "quality_rules":
            now = [(i, t) for i, t in now if not brute_counts(t)[5]]  # too few labels to certify any cutoff
        elif name == "line_dedup":
            now = [(i, t) for i, _, gone, t in brute_lines(now, 50) if not gone or t.split()]
        elif name == "near_dedup":
            kept = {i for i, _, _, k in brute_near(now, 80) if k}
            assert len(kept) < len(now)
            now = [(i, t) for i, t in now if i in kept]
        else:
            now = [(i, redacted(t)) for i, t in now]
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(now)
        assert docs.where("n_chars != length(text)").count() == 0
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, t in now:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        for p, s in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[s:first if p == 0 else s + 2048]
            want.append((i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) <= sum(w[3] for w in want) // 2048 + 2
