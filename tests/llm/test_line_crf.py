"""The conditional random field against enumeration, and its held-out accuracy."""

import itertools
import zlib

import duckdb
import numpy as np
import pytest

from loomrecord.llm.line_crf import FEATURES, LineCrf, line_features, marginals, score_quality, train


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    offsets, jump = np.array([0, 1, 6, 8, 12]), rng.normal(size=(2, 2))
    score = rng.normal(size=12)
    good, pairs = marginals(score, jump, offsets)
    for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        total, hits, both = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(score[a + i] for i in range(b - a) if y[i]) + sum(jump[y[i], y[i + 1]] for i in range(b - a - 1)))
            total += w
            hits += w * np.array(y)
            for i in range(b - a - 1):
                both[y[i], y[i + 1]] += w
        assert np.allclose(good[a:b], hits / total) and np.allclose(pairs[d], both / total)


def test_features_do_not_depend_on_the_batch():
    texts = ["A b. c!\n\nA b. c!", None, "", "x | y | z\n1 2 3 1 2 3", "é" * 50 + "\n" + "w " * 9000]
    x, size, offsets = line_features(texts)
    for i, t in enumerate(texts):
        alone = line_features([t])
        assert np.allclose(alone[0], x[offsets[i]:offsets[i + 1]]) and (alone[1] == size[offsets[i]:offsets[i + 1]]).all()
    assert np.isfinite(x).all() and x.shape[1] == FEATURES


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def trained(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, train(docs, spark.read.parquet(f"{sf}/labels.parquet"))


def test_held_out_accuracy(trained):
    docs, model = trained
    rows = duckdb.sql("SELECT doc_id, text, quality FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id)").fetchall()
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    y, s = np.array([r[2] for r in rows]), np.array(model.scores([r[1] for r in rows]))
    print("held-out AUC", auc(y, s), "good kept", ((s >= .3) & (y == 1)).sum() / (y == 1).sum(), "bad rejected", ((s < .3) & (y == 0)).sum() / (y == 0).sum())
    assert auc(y, s) > 0.93
    assert ((s >= .3) & (y == 1)).sum() >= 0.97 * (y == 1).sum()
    assert ((s < .3) & (y == 0)).sum() >= 0.6 * (y == 0).sum()


def test_odd_rows(spark, docs, trained):
    rows = [(0, None), (1, ""), (2, "\n\n\n"), (3, "One fine line."), (3, "One fine line."), (None, "One fine line."), (4, "x" * 300_000), (5, "\n".join("ab" for _ in range(9000)))]
    got = {(r.doc_id, i): r for i, r in enumerate(score_quality(docs(rows), trained[1]).collect())}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= .3) for r in got.values())
    assert all(r.held_out == (k[0] is not None and zlib.crc32(str(k[0]).encode()) % 5 == 0) for k, r in got.items())
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert isinstance(train(docs(rows), empty), LineCrf) and score_quality(docs([]), LineCrf()).count() == 0
    one = spark.createDataFrame([(3, 1), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in score_quality(docs(rows), train(docs(rows), one)).collect())


def test_tail_of_a_long_text_decides(spark, docs):
    """What tells good from bad stands only after a thousand equal lines."""
    head = "The same plain words.\n" * 1000
    rows = [(i, head + ("### $$$ %%% !!\n" if i % 2 else "A calm closing sentence, as ever.\n") * 600) for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    model = train(docs(rows), labels)
    scores = model.scores([t for _, t in rows])
    assert min(s for (i, _), s in zip(rows, scores) if not i % 2) > max(s for (i, _), s in zip(rows, scores) if i % 2)
