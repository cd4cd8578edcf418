"""Top-k search against brute force."""

import math
import random

import pytest

from loomrecord.llm.vector_search import top_k
from pyspark.sql import functions as F


def brute(rows, k=5):
    ok = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in ok:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in ok if m != n and len(w) == len(v))
            out += [(i, r + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("bucket", [16384, 40])
def test_top_k(spark, bucket):
    rnd = random.Random(bucket)
    near = [[rnd.gauss(0, .2) for _ in range(37)] for _ in range(6)]
    rows = [(i, [x + rnd.gauss(0, .02) for x in rnd.choice(near)]) for i in range(1, 300)]
    rows += [(i, near[0]) for i in range(300, 420)]  # ties
    rows += [(0, near[1]), (0, near[2]), (0, near[2]), (None, near[0]), (500, None), (501, [None, 1.0]), (550, [float("nan")] * 37), (600, [float("inf")] * 37), (650, []), (651, []),
             (700, [1.0, 2.0]), (701, [1e30, 3.0]), (702, [1.5, 2.5]), (750, [-1e30, 1e30])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, row int")
    got = top_k(df, F.col("vec_id") % 50 == 0, bucket_rows=bucket).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows)
    assert top_k(df.limit(0), F.lit(True)).count() == 0
