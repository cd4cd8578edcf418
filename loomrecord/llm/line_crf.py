"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its features and its neighbours' speak for either, and
neighbouring labels hang together. Forward-backward gives each line's marginal, and the
marginals weighted by line length make the document's quality, calibrated on the
training documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecord.llm.common import map_rows, written
from loomrecord.llm.shingles import WORDS, mix, rolling

_GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=+_{}[]\\/", b"|", b"!?", b".,;:'\"()-", bytes(range(128, 256)))
FEATURES = 6 + len(_GROUPS)
_CLASS = np.full(256, len(_GROUPS), np.uint8)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_CLASS[list(b" \t\n\r\x0b\x0c")] = len(_GROUPS) + 1


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, bytes of each line, offset of each text's first line); null is one empty line."""
    split = [(t or "").encode("utf-8", "surrogatepass").split(b"\n") for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(s) for s in split], out=offsets[1:])
    lines = [x for s in split for x in s]
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    start = np.cumsum(size + 1) - size - 1
    kinds = _CLASS[np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)]
    counts = []
    for i in range(len(_GROUPS) + 2):
        c = np.zeros(len(kinds) + 1, np.int64)
        np.cumsum(kinds == i, out=c[1:])
        counts.append(c[start + size] - c[start])
    solid = np.maximum(1, size - counts[-1])
    words = [x.split() for x in lines]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    get = WORDS.__getitem__
    h = np.fromiter((v for w in words for v in map(get, w)), np.uint64, n_words.sum())
    line_of = np.repeat(np.arange(len(lines)), n_words)
    text_of_line = np.repeat(np.arange(len(texts)), np.diff(offsets))
    text_of = text_of_line[line_of] if len(line_of) else line_of
    grams = rolling(h, 3)
    repeats = np.zeros(len(lines))
    if len(grams):
        inside = text_of[2:] == text_of[:-2]
        _, at, seen = np.unique(grams[inside] ^ mix(text_of[:-2][inside].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
        np.add.at(repeats, line_of[:-2][inside], seen[at] > 1)
    different = np.bincount(line_of[np.unique(h ^ mix(line_of.astype(np.uint64) + np.uint64(1)), return_index=True)[1]], minlength=len(lines)) if len(h) else np.zeros(len(lines))
    digest = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)) ^ mix(text_of_line.astype(np.uint64) + np.uint64(1))
    again = np.ones(len(lines))
    again[np.unique(digest, return_index=True)[1]] = 0
    n = np.maximum(1, n_words)
    columns = [np.log1p(size), np.log1p(n_words), np.minimum(solid / n, 40), repeats / n, different / n, again * (n_words > 0), *(c / solid for c in counts[:len(_GROUPS)])]
    return np.stack(columns, 1), size, offsets


def with_neighbours(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after (zero beyond the text), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[offsets[:-1]] = 0
    after[offsets[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], 1)


def marginals(score: np.ndarray, jump: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected label pairs summed per text [texts, 2, 2]) by forward-backward over all texts at once.

    `score` is the evidence for good over bad per line, `jump` the 2 x 2 weights of neighbours.
    """
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    first, length = offsets[:-1][order], length[order]
    longest = int(length[0]) if len(length) else 0
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(longest)]  # texts longer than t
    evidence = np.stack([np.zeros_like(score), score], 1)
    fore, back = np.zeros_like(evidence), np.zeros_like(evidence)
    for t in range(longest):
        at = first[:live[t]] + t
        fore[at] = evidence[at] if t == 0 else evidence[at] + np.logaddexp.reduce(fore[at - 1][:, :, None] + jump, 1)
    for t in range(longest - 2, -1, -1):
        at = first[:live[t + 1]] + t
        back[at] = np.logaddexp.reduce(jump[None] + (evidence[at + 1] + back[at + 1])[:, None, :], 2)
    both = fore + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    pairs = np.zeros((len(offsets) - 1, 2, 2))
    inner = np.ones(len(score), bool)
    inner[offsets[:-1]] = False
    at = np.flatnonzero(inner)
    if len(at):
        p = np.exp(fore[at - 1][:, :, None] + jump + (evidence[at] + back[at])[:, None, :] - total[at][:, None, None])
        np.add.at(pairs, np.searchsorted(offsets, at, "right") - 1, p)
    return good, pairs


class LineCrf:
    """Weights, feature scale and calibration; small, so it travels with the tasks."""

    def __init__(self, width: int = FEATURES):
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.weights, self.jump, self.a, self.b = np.zeros(3 * width + 1), np.zeros((2, 2)), 0.0, 0.0

    def _inputs(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, offsets)

    def document(self, x: np.ndarray, size: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, as log odds."""
        good, _ = marginals(self._inputs(x, offsets) @ self.weights, self.jump, offsets)
        weight = size + 1.0
        mean = np.add.reduceat(good * weight, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1])
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean) - np.log1p(-mean)

    def fit(self, parts: Callable, label: np.ndarray, steps: int = 120, l2: float = 0.02) -> LineCrf:
        """Gradient ascent on the penalised likelihood; every line of a training text carries the text's label.

        `parts(f)` adds up f(features, sizes, offsets, labels) over all shares of the
        texts, wherever they are; only sums come back.
        """
        rate = float(label.mean()) if len(label) else 0.5
        self.b = np.log((rate + 1e-3) / (1 - rate + 1e-3))
        if not len(label) or rate in (0.0, 1.0):
            return self
        lines, total = parts(lambda x, size, offsets, y: (float(len(x)), x.sum(0)))
        mean = total / lines
        (square,) = parts(lambda x, size, offsets, y: (((x - mean) ** 2).sum(0),))
        self.mean, self.scale = mean, np.sqrt(square / lines) + 1e-6
        m = [np.zeros_like(self.weights), np.zeros_like(self.jump)]
        v2 = [np.zeros_like(self.weights), np.zeros_like(self.jump)]
        for step in range(1, steps + 1):
            g1, g2 = parts(self.slope)
            slope = [g1 / len(label) - l2 * np.r_[self.weights[:-1], 0] / 10, g2 / len(label) - l2 * self.jump]
            for i, (g, w) in enumerate(zip(slope, (self.weights, self.jump))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v2[i] = 0.99 * v2[i] + 0.01 * g * g
                w += 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v2[i] / (1 - 0.99**step)) + 1e-8)
        return self

    def slope(self, x: np.ndarray, size: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What some whole texts add to the gradients of weights and jump; each text counts once, however long."""
        inputs, n = self._inputs(x, offsets), np.diff(offsets)
        good, pairs = marginals(inputs @ self.weights, self.jump, offsets)
        seen = np.zeros((2, 2))
        for v in (0, 1):
            seen[v, v] = ((n - 1) / n)[label == v].sum()
        return inputs.T @ ((np.repeat(label, n) - good) * np.repeat(1.0 / n, n)), seen - (pairs / n[:, None, None]).sum(0)

    def calibrate(self, z: np.ndarray, label: np.ndarray) -> LineCrf:
        """Logistic calibration of the texts' log odds by Newton steps, lightly penalised."""
        if not len(label) or label.mean() in (0.0, 1.0):
            return self
        a = b = 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * z + b)))
            q = p * (1 - p)
            h = np.array([[(q * z * z).sum() + 1, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
            da, db = np.linalg.solve(h, [((label - p) * z).sum() - a, (label - p).sum()])
            a, b = a + np.clip(da, -2, 2), b + np.clip(db, -2, 2)
        self.a, self.b = float(a), float(b)
        return self

    def scores(self, texts: list[str | None]) -> list[float]:
        z = self.a * self.document(*line_features(texts)) + self.b
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist()


def in_tasks(shares: DataFrame, kind: type = tuple) -> Callable:
    """Sums over shares (label, x, size, n) of the sample: a job for each call, of which a few numbers for each task come back; with kind list, all results in a row."""
    def parts(f):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                for r in batch.to_pylist():
                    n = np.frombuffer(r["n"], "<i8")
                    own = f(np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES).astype(float), np.frombuffer(r["size"], "<i8"), np.r_[0, np.cumsum(n)], np.frombuffer(r["label"], "<f8"))
                    held = own if held is None else held + own if kind is list else tuple(a + b for a, b in zip(held, own))
            if held is not None:
                yield pa.RecordBatch.from_pydict({"sums": [pickle.dumps(held)]})
        got = [pickle.loads(r.sums) for r in shares.mapInArrow(run, "sums binary").collect()]
        return [x for g in got for x in g] if kind is list else tuple(sum(x) for x in zip(*got))
    return parts


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, shares: int = 8, key: str = "doc_id", text: str = "text", label: str = "quality") -> LineCrf:
    """Fit on at most `sample` labelled documents, chosen by the hash of their key, all lines of each.

    Only labels 0 and 1 count; keys that carry both are left out; of documents with one
    key, one text is taken. The features are written once, dealt over `shares` tasks by
    key; gradients of whole texts are summed there. Sums, and one number per document of
    the sample, reach the driver.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (F.crc32(F.col(key).cast("string")) % 5 != 0))
    known = known.groupBy(F.col(key).alias("__key")).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi")
    chosen = known.orderBy(F.xxhash64("__key"), "__key").limit(sample).select("__key", F.col("lo").cast("double").alias("label"))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(chosen), "__key")
    rows = rows.groupBy("__key").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    rows = rows.repartition(shares, "__key").sortWithinPartitions("__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x, size, offsets = line_features(part.column(1).to_pylist())
                y = np.array(part.column(0).to_pylist(), "<f8")
                yield pa.RecordBatch.from_pydict({"label": [y.tobytes()], "x": [x.astype("<f4").tobytes()], "size": [size.astype("<i8").tobytes()], "n": [np.diff(offsets).astype("<i8").tobytes()]})
    held = written(rows.select("label", "text").mapInArrow(run, "label binary, x binary, size binary, n binary"), "lines")
    y = np.concatenate([np.frombuffer(r.label, "<f8") for r in held.select("label").collect()] or [np.zeros(0)])
    model = LineCrf().fit(in_tasks(held), y)
    odds = in_tasks(held, list)(lambda x, size, offsets, y: [(model.document(x, size, offsets), y)])
    return model.calibrate(np.concatenate([z for z, _ in odds]), np.concatenate([y for _, y in odds])) if odds else model


def score_quality(docs: DataFrame, model: LineCrf, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out (crc32 of the key as text is divisible by 5), score, predicted.

    Scores see the text alone, all of it. Null and empty texts are one empty line and
    get a score like any other. A null key is not held out. Rows stay as they are,
    repeats included; extra columns are ignored; no shuffle.
    """
    def make():
        def run(keys, held, texts):
            s = model.scores(texts)
            return {key: keys, "held_out": held, "score": s, "predicted": [int(x >= threshold) for x in s]}
        return run
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key), held.alias("held"), F.col(text).alias("text")), [key, "held", "text"], f"`{key}` {kind}, held_out boolean, score double, predicted int", make)
