"""Spans of personal data against Python's re, and contexts that find new identifiers."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from loomrecord.llm.pii import KINDS, find_pii, redact, span_text

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate(reversed(d))) % 10 == 0


def valid(kind, x):
    d = re.sub("[^0-9]", "", x)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in x.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(t):
    return [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(RX[k], t or "", re.A) if valid(k, m[0])]


def test_base_spans(spark, docs):
    rnd = random.Random(6)
    pool = ["a", "b@c.de", "@", ".", "x.y", "_", "+", "1", "12", "4111111111111111", "4111 1111-1111 1111", " ", "-", "  ", "255", "256", "1.2.3.4", "999.1.2.3", "007.0.0.000255", "+1 (017) 555-7713", "é", "𝄞", "\n", "(", ")", "+4930123456789", "00000000000000000", "%"]
    rows = [(i, "".join(rnd.choices(pool, k=rnd.randrange(60)))) for i in range(700)]
    rows += [(9000, None), (9001, ""), (9002, "a" * 60000), (9003, "1" * 60000), (9004, "1 " * 30000), (9005, "a." * 20000 + "@b" + ".c" * 20000), (9006, "+1" + " " * 50000), (None, "q@r.st"), (5, "q@r.st"), (5, "q@r.st")]
    got = find_pii(docs(rows)).select("doc_id", "text", span_text(KINDS).alias("s"), "pii").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.s == ",".join(brute(r.text)), r.text
        for k in (*KINDS, "id"):
            assert all(r.text[s.start:s.end].lower() == s.value.lower() for s in r.pii[k])
    assert find_pii(docs([])).count() == 0


def test_contexts_find_identifiers(spark, docs):
    rows = [(i, f"please write me at user{i}@mail.org or else, row {i} of {i + 7} things") for i in range(12)]
    rows += [(50, "please write me at zyx-993-k, thanks"), (51, "row 77 of 99 things"), (52, "me at nothing"), (53, "write me at zyx-993-k")] * 2
    found = find_pii(docs(rows))
    got = {r.doc_id: r for r in found.withColumn("s", span_text((*KINDS, "id"))).collect()}
    assert got[50].s == "id:19:28" and [s.value for s in got[50].pii.id] == ["zyx-993-k"] and got[53].s == "id:12:21"
    assert got[51].s == got[52].s == "" and got[3].s == "email:19:33"
    clean = {r.doc_id: r.text for r in redact(found).collect()}
    assert clean[50] == "please write me at [ID], thanks" and clean[3] == "please write me at [EMAIL] or else, row 3 of 10 things" and clean[52] == "me at nothing"
    # A copied text is one piece of evidence, not many.
    same = find_pii(docs([(i, "only me at one@mail.org") for i in range(9)] + [(99, "only me at k-123-9")]))
    assert same.where(F.size("pii.id") > 0).count() == 0
    assert hashlib.sha256(b"").hexdigest() == same.select(F.sha2(span_text(("ip",)), 256)).first()[0]
