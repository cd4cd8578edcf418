"""Exact top-k by inner product: branch and bound over vertical blocks of dimensions.

Candidates are dealt into buckets; the stated queries go to every bucket. In a bucket
the vectors lie dimension by dimension. Partial products grow block by block, the mass
still to come is bounded by the norms of the remaining dimensions, and candidates whose
best case lies below the k-th worst case are compacted away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


class Bucket:
    """Vectors of one length, held dimension by dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, step: int):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.columns, self.step = rows[order], ids[order], np.ascontiguousarray(values[order].T), step
        self.place = {r: i for i, r in enumerate(self.rows.tolist())}
        self.most = float(np.abs(values).max(initial=0.0))
        squares = self.columns ** 2 if self.most < 1e150 else np.full(self.columns.shape, np.inf)
        self.rest = [np.sqrt(squares[a:].sum(0)) for a in [*range(step, len(self.columns), step), len(self.columns)]]

    def _plain(self, query: np.ndarray, k: int, own: int | None) -> list[tuple[int, int]]:
        """Values too large for exact floating point: whole numbers of any size, saturated to 64 bits."""
        q = [int(x) for x in query]
        scores = [(min(max(sum(a * int(b) for a, b in zip(q, col)), LONG[0]), LONG[1]), i) for i, col in enumerate(self.columns.T) if i != own]
        return [(i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]

    def search(self, queries: np.ndarray, rows: list[int], k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(place in `queries`, [(place here, score)]), the k best each, ties to the smaller id."""
        dims, step, n = len(self.columns), self.step, len(self.ids)
        most = float(np.abs(queries).max(initial=0.0))
        if most * self.most * max(1, dims) >= EXACT:
            for i, q in enumerate(queries):
                yield i, self._plain(q, k, self.place.get(rows[i]))
            return
        first = queries[:, :step] @ self.columns[:step]
        for i, q in enumerate(queries):
            alive, part = np.arange(n), first[i]
            if (own := self.place.get(rows[i])) is not None:
                alive, part = np.delete(alive, own), np.delete(part, own)
            for b, a in enumerate(range(step, dims + step, step)):
                if len(alive) > k:
                    slack = np.sqrt((q[a:] ** 2).sum()) * self.rest[b][alive] * (1 + 1e-9) + 1e-6
                    worst = part - slack
                    keep = part + slack >= np.partition(worst, len(worst) - k)[len(worst) - k]
                    alive, part = alive[keep], part[keep]
                if a < dims:
                    part = part + q[a:a + step] @ self.columns[a:a + step][:, alive]
            order = np.lexsort((alive, -part))[:k]
            yield i, list(zip(alive[order].tolist(), part[order].astype(np.int64).tolist()))


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", bucket_rows: int = 16384, step: int = 16, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best rows but itself, by the inner product of floor(scale * x).

    Vectors that are null or hold null or non-finite components, and rows with a null
    key, take no part; vectors of another length than the query's are not compared.
    Empty vectors score 0. Rows are told apart by place, so rows repeating a key are
    candidates of each other and each repeated query row is ranked by itself. Scores
    beyond 64 bits saturate. Bucket size bounds a task's memory; it never drops rows.
    """
    spark = df.sparkSession
    v = F.col(vector).cast("array<double>")
    valid = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(valid).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    buckets = max(spark.sparkContext.defaultParallelism, -(-rows.count() // bucket_rows))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    own = F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")
    dealt = rows.select("id", "v", "row", F.explode(F.concat(
        F.array(F.struct(own.alias("bucket"), F.lit(0).alias("kind"))),
        F.when(F.col("q"), F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.struct(b.cast("int").alias("bucket"), F.lit(1).alias("kind")))).otherwise(F.array()))).alias("to"))
    dealt = dealt.select("to.bucket", "to.kind", "id", "row", "v").repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        ready: dict[int, Bucket] = {}
        at = None
        for batch in batches:
            bucket, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, place, vec = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4)
            lengths = np.asarray(vec.value_lengths())
            flat = np.floor(scale * vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ends = np.cumsum(lengths)
            cuts = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | (np.diff(kind) != 0)])
            for s, e in zip(cuts, [*cuts[1:], len(bucket)]):
                if bucket[s] != at:
                    at, held, ready = bucket[s], {}, {}
                for d in np.unique(lengths[s:e]).tolist():
                    sel = s + np.flatnonzero(lengths[s:e] == d)
                    values = flat[(ends[sel] - d)[:, None] + np.arange(d)] if d else np.zeros((len(sel), 0))
                    if kind[s] == 0:
                        held.setdefault(d, []).append((place[sel], ids[sel], values))
                        continue
                    if d not in ready and d in held:
                        ready[d] = Bucket(*(np.concatenate(x) for x in zip(*held.pop(d))), step)
                    for a in range(0, len(sel) if d in ready else 0, 128):
                        part, found = sel[a:a + 128], ready[d]
                        out: list[list] = [[], [], [], []]
                        for i, best in found.search(values[a:a + 128], place[part].tolist(), k):
                            for j, score in best:
                                for col, x in zip(out, (place[part[i]], ids[part[i]], found.ids[j], score)):
                                    col.append(int(x))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["row", "query_id", "vec_id", "score"])
    found = dealt.mapInArrow(scan, "row bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
