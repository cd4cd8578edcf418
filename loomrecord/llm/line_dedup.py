"""Repeated runs of lines, by winnowing over line hashes.

A window is the shortest run of lines that holds `min_words` words, from one line on or
up to one line; every line of a longer run lies in a window inside that run. Each window
selects its line of the smallest hash, so equal windows select the same place and no
repeated run goes without a fingerprint. Selected lines meet by their hash. Those that
occur again grow both ways over the windows that selected them: what surrounds a line
may differ from one occurrence to the next, so the lines of each window as a whole find
its earliest place, and no occurrence is compared with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecord.llm.common import written
from loomrecord.llm.shingles import mix

#: Odd multipliers of the two rolling hashes of lines, and their inverses modulo 2^64.
_STEPS = [(0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)), (0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64))]
_TEXTS = 512
#: Tasks over which the occurrences of one fingerprint are dealt.
SALTS = 16


def split_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each \\n-split line, its words, where each text's lines begin) of all texts one after another."""
    split = [t.encode("utf-8", "surrogatepass").split(b"\n") for t in texts]
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(s) for s in split], out=begins[1:])
    n = int(begins[-1])
    return np.fromiter((h for s in split for h in map(xxhash.xxh3_64_intdigest, s)), np.uint64, n), np.fromiter((len(x.split()) for s in split for x in s), np.int64, n), begins


def windows(words: np.ndarray, begins: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first lines, ends) of all windows, each once and within one text."""
    n = len(words)
    held = np.zeros(n + 1, np.int64)
    np.cumsum(words, out=held[1:])
    line = np.arange(n)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    end = np.searchsorted(held, held[:-1] + min_words)  # of the window from each line on
    start = np.searchsorted(held, held[1:] - min_words, "right") - 1  # of the window up to each line
    on, up = end <= begins[1:][text], start >= begins[:-1][text]
    both = np.unique(np.concatenate((line[on] << 32 | end[on], start[up] << 32 | line[up] + 1)))
    return both >> 32, both & 0xFFFFFFFF


def selected(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The leftmost line of the smallest hash in each window, by minima over powers of two."""
    level, size, at = np.arange(len(h)), end - first, np.zeros(len(first), np.int64)
    power = 1
    while len(first) and power <= size.max():
        now = (size >= power) & (size < 2 * power)
        a, b = level[first[now]], level[end[now] - power]
        at[now] = np.where(h[b] < h[a], b, a)
        a, b = level[:-power], level[power:]
        level = np.where(h[b] < h[a], b, a)
        power *= 2
    return at


def contents(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """128 bits of the lines of each window, in order."""
    out = []
    with np.errstate(over="ignore"):
        for k, (step, back) in enumerate(_STEPS):
            power, unpower = (np.cumprod(np.r_[np.uint64(1), np.full(len(h), np.uint64(x))], dtype=np.uint64) for x in (step, back))
            held = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(mix(h + np.uint64(k)) * power[:-1], out=held[1:])
            out.append(mix((held[end] - held[first]) * unpower[first] ^ mix((end - first).astype(np.uint64))).view(np.int64))
    return out


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """From (doc, tag, text): (hash, doc, tag, around) per selected line, `around` being the windows that selected it."""
    around = pa.struct([("c1", pa.int64()), ("c2", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(i, _TEXTS)
                h, words, begins = split_lines(part.column(2).to_pylist())
                first, end = windows(words, begins, min_words)
                at = selected(np.where(words > 0, h, np.uint64(2**64 - 1)), first, end)
                order = np.argsort(at, kind="stable")
                first, end, at = first[order], end[order], at[order]
                c1, c2 = contents(h, first, end)
                new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
                text = np.searchsorted(begins, at, "right") - 1
                begin = begins[text]
                items = pa.StructArray.from_arrays([pa.array(c1), pa.array(c2), pa.array((first - begin).astype(np.int32)), pa.array((end - begin).astype(np.int32))], fields=list(around))
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), items)
                owner = pa.array(text[new])
                yield pa.RecordBatch.from_arrays([pa.array(h[at[new]].view(np.int64)), part.column(0).take(owner), part.column(1).take(owner), lists], names=["hash", "doc", "tag", "around"])
    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "tag", "text").mapInArrow(run, f"hash bigint, doc {kind}, tag bigint, around array<struct<c1:bigint,c2:bigint,start:int,end:int>>")


def merged(spans: DataFrame) -> DataFrame:
    """(doc, tag, spans) with overlapping and touching spans made one, in order."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat = column.flatten()
            row = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
            start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) + (row << 32) for i in (0, 1))
            order = np.argsort(start, kind="stable")  # rows lie so far apart that spans of two never touch
            start, end, row = start[order], np.maximum.accumulate(end[order]) if len(order) else end, row[order]
            new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]]) if len(start) else start
            last = np.append(new[1:], len(start)) - 1 if len(new) else new
            base = row[new] << 32
            items = pa.StructArray.from_arrays([pa.array((start[new] - base).astype(np.int32)), pa.array((end[last] - base).astype(np.int32))], fields=list(span))
            offsets = np.searchsorted(row[new], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["doc", "tag", "spans"])
    kind = spans.schema["doc"].dataType.simpleString()
    return spans.select("doc", "tag", "spans").mapInArrow(run, f"doc {kind}, tag bigint, spans array<struct<start:int,end:int>>")


def repeated_runs(docs: DataFrame, min_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tag, spans): per document with repeated runs, the line spans [start, end) to delete, merged and in order.

    Documents are told apart by key and text hash (`tag`); identical rows count as one.
    """
    base = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("tag"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    found = written(fingerprints(base, min_words), "fingerprints")
    again = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    near = found.withColumn("salt", F.pmod("tag", F.lit(SALTS))).join(again, ["hash", "salt"]).select("doc", "tag", F.inline("around"))
    here = F.struct("doc", "tag", "start")
    earliest = near.groupBy("c1", "c2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("c1", "c2", "first")
    later = near.join(earliest, ["c1", "c2"]).where(F.col("first") < here)
    return merged(later.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans")))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def remove_repeated_lines(docs: DataFrame, min_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs with repeated runs deleted from `text`, and a struct `line_dedup` (n_lines, n_removed).

    A run of lines of at least `min_words` words that equals, line by line, a run that
    starts earlier (by key, then text hash, then line) is deleted with all the equal
    lines around it; the first occurrence stays. Occurrences may overlap: of a hundred
    equal lines the first stays, as the run from the second line on equals the one from
    the first. Lines split at \\n; null text has no lines and stays null, empty text has
    one. Keys of any type that has an order; rows with a null key stay whole and are
    nobody's source. Rows equal in key and text are one document and lose the same
    lines. Extra columns pass through. A column named line_dedup is replaced.
    """
    columns = [c for c in docs.columns if c != "line_dedup"]
    doc, tag, spans, lines = (_free(c, columns) for c in ("run_doc", "run_tag", "run_spans", "run_lines"))
    found = repeated_runs(docs, min_words, key, text).select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("spans").alias(spans))
    joined = docs.select(*columns).withColumn(lines, F.xxhash64(text))
    joined = joined.join(found, (F.col(key) == F.col(doc)) & (F.col(lines) == F.col(tag)), "left").withColumn(lines, F.split(F.col(text), "\n", -1))
    # What lies between the spans, in order: each line is passed once.
    begins = F.concat(F.array(F.lit(0)), F.col(f"{spans}.end"))
    ends = F.concat(F.col(f"{spans}.start"), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    gone = F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"])
    fresh = F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    counts = F.struct(n_lines.cast("bigint").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("bigint").alias("n_removed"))
    return joined.select(*[fresh.alias(c) if c == text else F.col(c) for c in columns], counts.alias("line_dedup"))
