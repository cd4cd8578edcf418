"""Whitening of embeddings by Jacobi-Davidson, with matrix-free products on Spark.

The covariance is never formed. A product with it is one job over the fit list: each
task centres its block of vectors, multiplies by the few wanted directions and back, and
the partial sums are added up. Correction equations, projected against what is known,
are solved by some steps of MINRES; Rayleigh-Ritz in the grown subspace gives new
candidates; converged ones are locked until all residuals are at double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrecord.llm.common import written

#: A residual at most this times the largest eigenvalue is rounding.
TOLERANCE = 100 * np.finfo(float).eps
#: Vectors of one block of the fit list.
BLOCK = 4096
_LONG = (-(2**63), 2**63 - 1)


def clean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, x): finite vectors as floor(256 * c), of the most frequent length (of equally frequent ones, the longest)."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.where(F.col(vector).isNotNull()).where(F.coalesce(whole, F.lit(False)) & (F.size(vector) > 0))
    kept = kept.select(F.col(key).alias("vec_id"), F.transform(x, lambda c: F.floor(256 * c).cast("bigint")).alias("x"))
    size = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return kept.where(F.size("x") == (size[0].d if size else 0))


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """Rows of a list column, all of length d."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def in_blocks(vectors: DataFrame, d: int) -> DataFrame:
    """Blocks of the fit list as little-endian 64-bit integers, each with its size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                yield pa.RecordBatch.from_pydict({"n": [part.num_rows], "block": [matrix(part.column(0), d).astype("<i8").tobytes()]}, schema=pa.schema([("n", pa.int64()), ("block", pa.binary())]))
    return vectors.select("x").mapInArrow(run, "n bigint, block binary")


class FitList:
    """The distinct vectors, in blocks, and sums over them."""

    def __init__(self, vectors: DataFrame, d: int):
        self.d = d
        self.blocks = written(in_blocks(vectors.select("x").distinct(), d), "fit")
        totals = self.blocks.agg(F.sum("n")).collect()[0][0]
        self.n = int(totals or 0)
        # Exact sums: each block's in two halves that can't overflow, added as decimals.
        high, low = (self.total(lambda x, h=h: ((x >> 32) if h else (x & 0xFFFFFFFF)).sum(0), d, "decimal(38,0)") for h in (True, False))
        self.sums = [(int(h) << 32) + int(w) for h, w in zip(high, low)]
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(d)

    def total(self, part: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> list:
        """Sum over all blocks of `part(block)`, an array of `size` numbers; tasks add their own blocks first."""
        d, exact = self.d, kind != "double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(size, np.int64 if exact else float)
            seen = 0
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    held = held + part(np.frombuffer(raw, "<i8").reshape(-1, d))
                    seen += 1
                    if exact and seen % 1024 == 0:  # 1024 blocks of 4096 halves stay below 2^63
                        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(held)], names=["at", "part"])
                        held = np.zeros(size, np.int64)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(held)], names=["at", "part"])
        parts = self.blocks.select("block").mapInArrow(run, f"at int, part {'bigint' if exact else 'double'}")
        rows = parts.groupBy("at").agg(F.sum(F.col("part").cast(kind)).alias("v")).collect()  # `size` rows
        out = [0] * size
        for r in rows:
            out[r["at"]] = r.v
        return out

    def product(self, u: np.ndarray) -> np.ndarray:
        """Covariance times the columns of u."""
        mean, n = self.mean, self.n

        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return (c.T @ (c @ u)).ravel() / n
        return np.array(self.total(part, u.size), float).reshape(u.shape)

    def trace(self) -> float:
        mean, n = self.mean, self.n
        return float(self.total(lambda x: np.array([((x - mean) ** 2).sum() / n]), 1)[0])

    def projected_moments(self, u: np.ndarray) -> np.ndarray:
        """Covariance of the projections on the columns of u, from the vectors themselves."""
        mean, n, m = self.mean, self.n, u.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            p = (x - mean) @ u
            return np.r_[(p.T @ p).ravel(), p.sum(0)] / n
        got = np.array(self.total(part, m * m + m), float)
        return got[:m * m].reshape(m, m) - np.outer(got[m * m:], got[m * m:])


def _orthonormal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns of t made orthonormal and orthogonal to those of `against`, twice over; what is left of none goes."""
    kept: list[np.ndarray] = []
    for v in t.T:
        size = np.linalg.norm(v)
        if not size or not np.isfinite(size):
            continue
        v = v / size
        for _ in range(3):
            for q in against:
                v = v - q @ (q.T @ v)
            for w in kept:
                v = v - w * (w @ v)
            size = np.linalg.norm(v)
            if size < 1e-8:
                break
            v = v / size
        else:
            kept.append(v)
    return np.stack(kept, 1) if kept else np.zeros((len(t), 0))


def minres(product: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, known: list[np.ndarray], r: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of (I - QQ')(V - theta)(I - QQ') t = -r, each column with its own theta and Q; one product for all in each step."""
    d, m = r.shape
    off = lambda v, k: v - known[k] @ (known[k].T @ v)
    start = np.stack([off(-r[:, k], k) for k in range(m)], 1)
    beta = np.linalg.norm(start, axis=0)
    basis = [[start[:, k] / beta[k] if beta[k] else np.zeros(d)] for k in range(m)]
    tri = [np.zeros((steps + 1, steps)) for _ in range(m)]
    done = np.zeros(m, int)
    live = beta > 0
    for j in range(steps):
        if not live.any():
            break
        at = np.flatnonzero(live)
        image = product(np.stack([basis[k][j] for k in at], 1))
        for c, k in enumerate(at):
            w = off(image[:, c] - theta[k] * basis[k][j], k)
            for _ in range(2):  # the recurrence, with full orthogonalisation: the basis is short
                for i, q in enumerate(basis[k]):
                    s = q @ w
                    w, tri[k][i, j] = w - s * q, tri[k][i, j] + s
            tri[k][j + 1, j] = size = np.linalg.norm(w)
            done[k] = j + 1
            if size < 1e-13 * max(1e-300, np.abs(tri[k][:j + 1, :j + 1]).max()):
                live[k] = False
            else:
                basis[k].append(w / size)
    out = np.zeros((d, m))
    for k in range(m):
        if n := done[k]:
            y = np.linalg.lstsq(tri[k][:n + 1, :n], np.r_[beta[k], np.zeros(n)], rcond=None)[0]
            out[:, k] = np.stack(basis[k][:n], 1) @ y
    return out


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = 4, steps: int = 6, most: int = 40, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(largest eigenvalues, falling; unit eigenvectors as columns) of a symmetric positive semidefinite operator.

    The subspace restarts from its best directions beyond `most`. Only d x most numbers
    live on the driver. Raises if the residuals don't reach TOLERANCE in `rounds`.
    """
    wanted = min(wanted, d)
    # A block somewhat wider than asked for: eigenvalues that lie close come together.
    block = min(d, wanted + 2)
    basis = _orthonormal(np.random.default_rng(0).standard_normal((d, block)))
    image = product(basis)
    locked, values = np.zeros((d, 0)), []
    for _ in range(rounds):
        ritz, s = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        order = np.argsort(-ritz, kind="stable")
        ritz, s = ritz[order], s[:, order]
        vectors, moved = basis @ s, image @ s
        scale = max([*values, ritz[0] if len(ritz) else 0.0, 0.0])
        size = np.linalg.norm(moved - vectors * ritz, axis=0)
        good = 0
        while good < min(wanted - len(values), len(ritz)) and size[good] <= TOLERANCE * scale:
            good += 1
        if good:  # in order: nothing larger is still open
            locked = np.concatenate([locked, vectors[:, :good]], 1)
            values += ritz[:good].tolist()
            vectors, moved, ritz = vectors[:, good:], moved[:, good:], ritz[good:]
            basis, image = vectors, moved
        if len(values) == wanted:
            order = np.argsort(-np.array(values), kind="stable")
            return np.array(values)[order], locked[:, order]
        if basis.shape[1] > most:
            basis, image = vectors[:, :most // 2], moved[:, :most // 2]
        need = min(block, wanted - len(values) + 2, len(ritz))
        r = moved[:, :need] - vectors[:, :need] * ritz[:need]
        open_ = np.flatnonzero(np.linalg.norm(r, axis=0) > TOLERANCE * scale)
        known = [np.concatenate([locked, vectors[:, [k]]], 1) for k in open_]
        t = minres(product, ritz[open_], known, r[:, open_], steps) if len(open_) else np.zeros((d, 0))
        fresh = _orthonormal(np.concatenate([t, r[:, open_]], 1), locked, basis)
        if not fresh.shape[1]:  # the subspace is the whole space, or holds the solution up to rounding
            room = d - locked.shape[1] - basis.shape[1]
            fresh = _orthonormal(np.random.default_rng(len(values) + basis.shape[1]).standard_normal((d, min(room, block))), locked, basis) if room > 0 else fresh
        if fresh.shape[1]:
            basis, image = np.concatenate([basis, fresh], 1), np.concatenate([image, product(fresh)], 1)
        else:  # renew the products of an exhausted basis, whose rounding has added up
            basis = _orthonormal(basis, locked)
            image = product(basis)
    raise ArithmeticError(f"{len(values)} of {wanted} components converged")


def _saturated(v: int) -> int:
    return min(max(v, _LONG[0]), _LONG[1])


def whiten(df: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per clean row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries go, and so do
    those whose length is not the most frequent one. The fit list has each distinct
    integer vector once; repeated rows and null keys each get their rows. Components
    whose eigenvalue is zero up to rounding cannot be whitened and are left out, so
    equal vectors only, or an empty table, give no rows. deviation saturates at 64 bits.
    Other columns are ignored.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind)] + [T.StructField(c, t) for c, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))])
    clean = clean_vectors(df, key, vector)
    head = clean.select(F.size("x").alias("d")).limit(1).collect()
    if not head:
        return df.sparkSession.createDataFrame([], schema)
    d = head[0].d
    fit = FitList(clean, d)
    trace = fit.trace()
    values, vectors = jacobi_davidson(fit.product, d, components) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    used = values > d * TOLERANCE * max([*values, 0.0])
    values, vectors = values[used], vectors[:, used]
    if not len(values):
        return df.sparkSession.createDataFrame([], schema)
    scaled = vectors / np.sqrt(values)
    error = float(np.abs(fit.projected_moments(scaled) - np.eye(len(values))).max())
    n, sums, mean, explained, m = fit.n, fit.sums, fit.mean, (values / trace).tolist(), len(values)
    arrow = pa.schema([(c, t) for c, t in zip(("vec_id", "component", "n", "deviation", "whitened"), (None, pa.int32(), pa.int64(), pa.int64(), pa.float64())) if t])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sums, object)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                x = matrix(part.column(1), d)
                gap = float(n) * np.abs(x).max(initial=0) + float(max(map(abs, sums)))
                if gap * gap * d < 2.0**62:
                    deviation = ((n * x - exact.astype(np.int64)) ** 2).sum(1).tolist()
                else:
                    deviation = [_saturated(int(v)) for v in ((n * x.astype(object) - exact) ** 2).sum(1)]
                rows = len(x)
                columns = [pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)), pa.array(np.full(rows * m, n)), pa.array(np.repeat(np.array(deviation, np.int64), m)), pa.array(((x - mean) @ scaled).ravel())]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(rows), m)))
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["vec_id", *arrow.names])
    out = clean.mapInArrow(run, T.StructType([T.StructField("vec_id", kind), *schema.fields[1:5]]))
    shares = F.element_at(F.array(*[F.lit(v) for v in explained]), F.col("component"))
    return out.select(F.col("vec_id").alias(key), "component", "n", "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))
