"""Compare registered queries with their check SQL: python -m tests.oracle [name ...]."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v) if v % 1 else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return int(v) if v == int(v) else round(v, 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, fn, sql):
    df = fn(spark, sf)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, f"{len(got[1])} rows, no SQL"
    rel = con.sql(sql)
    want = normal(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return False, f"rows {len(got[1])} vs {len(want[1])}; only spark {sorted(a - b, key=repr)[:2]}; only sql {sorted(b - a, key=repr)[:2]}"
    return True, f"{len(got[1])} rows"


def main(names, sf):
    from loomrecord.plans import CHECKS, QUERIES
    from tests.session import make

    spark, con = make(), duck(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, sf, fn, CHECKS.get(name))
        except Exception as e:  # a report tool: keep going
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += ok is False
        if ok is not True or time.time() - t > 4:
            print(f"{'FAIL' if ok is False else 'ok'} {name} {time.time() - t:.1f}s {note}", flush=True)
    print("failures:", bad, "of", len(QUERIES))


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.001" if "--small" in args else "/root/testdata/sf0.01"
    main([a for a in args if not a.startswith("--")], sf)
