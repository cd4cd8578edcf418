"""Jacobi-Davidson and whitening against a dense solver."""

import math
import random

import numpy as np
import pytest

from loomrecord.llm.whitening import jacobi_davidson, whiten


@pytest.mark.parametrize("spectrum", [
    np.linspace(1, 2, 64), np.r_[np.full(30, 1.0), np.full(34, 0.5)], np.r_[5.0, 5.0, 5.0, 5.0, 5.0, np.ones(59)], 10.0 ** -np.arange(0, 16, .25), np.ones(3), np.array([2.0]), np.r_[3.0, np.zeros(40)],
    1 + 1e-3 * np.random.default_rng(3).standard_normal(128)])
def test_eigenpairs(spectrum):
    d = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))[0]
    v = q * spectrum @ q.T
    values, vectors = jacobi_davidson(lambda u: v @ u, d)
    m = min(4, d)
    assert np.allclose(values, np.sort(spectrum)[::-1][:m], atol=1e-12 * spectrum.max(), rtol=0)
    assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-13
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-12 * spectrum.max()


def brute(rows):
    x = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = []
    for i, v in x:
        dev = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        p = (np.array(v, float) - np.array(sums) / n) @ vectors / np.sqrt(values)
        out += [(i, k + 1, n, dev, p[k], values[k] / np.trace(cov)) for k in range(len(values))]
    return out


def test_whiten(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1 / (k + 1)) for k in range(9)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)] + [(5, rows[9][1]), (5, rows[9][1]), (None, rows[3][1])]
    bad = [(500, None), (501, [None] + [0.0] * 8), (502, [float("nan")] + [0.0] * 8), (503, [float("inf")] * 9), (504, [])]
    df = spark.createDataFrame([(i, v, "x", 2.0) for i, v in rows + bad + [(505, [1.0, 2.0])]], "vec_id long, embedding array<double>, x string, n double")
    got = whiten(df).collect()
    want = brute(rows + bad)
    at = lambda r: (str(r[0]), r[3], r[1])
    got, want = sorted(got, key=at), sorted(want, key=at)
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [w[:4] for w in want]
    sign = {}
    for r, w in zip(got, want):
        if abs(w[4]) > .1:
            sign.setdefault(r.component, math.copysign(1, r.whitened * w[4]))
        assert abs(r.whitened * sign.get(r.component, 1) - w[4]) < 1e-9 or r.component not in sign
        assert abs(r.explained - w[5]) < 1e-10 and r.identity_error < 1e-10
    assert len({r.identity_error for r in got}) == 1 and set(sign) == {1, 2, 3, 4}


def test_whiten_edges(spark):
    frame = lambda rows, kind="float": spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    assert whiten(frame([])).count() == 0
    assert whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    flat = whiten(frame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r.component for r in flat} == {1} and all(abs(r.explained - 1) < 1e-12 for r in flat)
    huge = whiten(frame([(i, [1e15 * i, -1e15]) for i in range(4)], "double")).collect()
    assert len(huge) == 4 and all(r.deviation == 2**63 - 1 for r in huge if r.vec_id in (0, 3))
