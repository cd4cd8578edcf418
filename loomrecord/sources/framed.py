"""Framed text: physical lines with byte positions, as a batch, streaming and writing source.

A partition is a byte range and owns the lines that start in it. Lines end at LF;
one CR directly before it belongs to the delimiter. A last line without LF is a
record in a batch read, and waits for its end in a streaming read.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "source_id string, generation string, ordinal bigint, byte_start bigint, byte_end bigint, content_len bigint, delim_len int, raw binary"
COUNT_SCHEMA = "source_id string, split_start bigint, lines bigint"
ARROW = pa.schema([
    ("source_id", pa.string()), ("generation", pa.string()), ("ordinal", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()),
    ("content_len", pa.int64()), ("delim_len", pa.int32()), ("raw", pa.binary()),
])
CHUNK = 4 << 20
BATCH_ROWS = 8192


def open_path(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int, int]]:
    """(path, size, mtime in ns) of a file, or of the data files below a folder, in name order."""
    fs, root = open_path(path)
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    files = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((f.path, f.size, f.mtime_ns or 0) for f in files)


@dataclass
class ByteRange(InputPartition):
    source: str
    generation: str
    start: int
    end: int
    base: int = 0
    need_end: bool = False


def blocks(fs, part: ByteRange):
    """(byte_start, bytes) of whole lines, read in chunks, that start inside the range.

    Only new bytes are searched, and a chunk without a line end doubles the next read,
    so a line of any length costs time in proportion to it.
    """
    with fs.open_input_file(part.source) as f:
        at = part.start
        if at > 0:
            # Not at a line start unless the byte before is LF: skip to the first one.
            at -= 1
            f.seek(at)
            while True:
                buf = f.read(CHUNK)
                if not buf:
                    return
                hit = buf.find(b"\n")
                if hit >= 0:
                    at += hit + 1
                    break
                at += len(buf)
        f.seek(at)
        rest, want = b"", CHUNK
        while at < part.end:
            buf = f.read(want)
            if not buf:
                if rest and not part.need_end:
                    yield at, rest
                return
            data, known = rest + buf, len(rest)
            last = data.rfind(b"\n", known)
            if last < 0:
                rest, want = data, 2 * want
                continue
            room = part.end - at
            if last >= room:  # the last line that starts in the range ends at the first LF from its last byte on
                stop = data.find(b"\n", room - 1)
                yield at, data[:stop + 1]
                return
            yield at, data[:last + 1]
            at, rest, want = at + last + 1, data[last + 1:], CHUNK


def count_lines(fs, part: ByteRange) -> int:
    """Lines that start inside the range: one at the file's start, one behind every LF that lies one byte earlier."""
    with fs.open_input_file(part.source) as f:
        found, left = int(part.start == 0 and f.size() > 0), part.end - 1 - max(0, part.start - 1)
        f.seek(max(0, part.start - 1))
        while left > 0 and (buf := f.read(min(CHUNK, left))):
            found += buf.count(b"\n")
            left -= len(buf)
    return found


def line_columns(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Starts, content lengths, delimiter lengths and contents of a block's lines, from the places of its LFs."""
    data = np.frombuffer(block, np.uint8)
    lf = np.flatnonzero(data == 10)
    whole = len(lf) > 0 and lf[-1] == len(data) - 1
    starts = np.r_[0, lf + 1][:len(lf) + (not whole)]
    ends = lf if whole else np.r_[lf, len(data)]
    delim = np.ones(len(ends), np.int32)
    if not whole:
        delim[-1] = 0
    cr = (ends > starts) & (delim > 0) & (data[ends - 1] == 13)
    delim += cr.astype(np.int32)
    keep = np.ones(len(data), bool)
    keep[lf] = False
    keep[ends[cr] - 1] = False
    length = ends - cr - starts
    offsets = np.zeros(len(length) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    return starts, length, delim, pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])


def lines(fs, part: ByteRange):
    """(byte_start, content, delim_len) of the lines that start inside the range."""
    for at, block in blocks(fs, part):
        starts, _, delim, contents = line_columns(block)
        yield from zip((at + starts).tolist(), contents.to_pylist(), delim.tolist())


def batches(part: ByteRange):
    fs, _ = open_path(part.source)
    first = part.base
    for at, block in blocks(fs, part):
        starts, length, delim, contents = line_columns(block)
        n = len(starts)
        batch = pa.RecordBatch.from_arrays([
            pa.array([part.source] * n, pa.string()), pa.array([part.generation] * n, pa.string()), pa.array(np.arange(first, first + n)), pa.array(at + starts),
            pa.array(at + starts + length), pa.array(length), pa.array(delim), contents,
        ], schema=ARROW)
        first += n
        for i in range(0, n, BATCH_ROWS):
            yield batch.slice(i, BATCH_ROWS)


def generation_of(size: int, mtime: int) -> str:
    return hashlib.sha256(f"{size}:{mtime}".encode()).hexdigest()[:16]


class FramedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "records")
        self.split = int(options.get("splitbytes", 128 << 20))
        self.bases = options.get("bases")

    def partitions(self):
        base = {}
        if self.bases:
            for name, _, _ in list_files(self.bases):
                fs, _ = open_path(name)
                with fs.open_input_stream(name) as f:
                    for line in f.read().splitlines():
                        row = json.loads(line)
                        base[row["source_id"], row["split_start"]] = row["base"]
        out = []
        for name, size, mtime in list_files(self.path):
            for start in range(0, size, self.split):
                out.append(ByteRange(name, generation_of(size, mtime), start, min(start + self.split, size), base.get((name, start), 0)))
        return out or [ByteRange("", "", 0, 0)]

    def read(self, partition):
        if not partition.source:
            return
        if self.mode == "count":
            fs, _ = open_path(partition.source)
            yield (partition.source, partition.start, count_lines(fs, partition))
        else:
            yield from batches(partition)


#: Bytes at the start of a file and before an offset whose digests tell whether it is still the same file.
PROOF = 64 << 10


def digest_of(f, start: int, end: int) -> str:
    f.seek(start)
    return hashlib.sha256(f.read(end - start)).hexdigest()


class FramedStream(DataSourceStreamReader):
    """Follows growing files.

    The offset of a file is the end of its last whole line, with digests of the bytes at
    its start and before that end. A file that shrank, went away or holds other bytes
    there, be it as large as before or larger, is a new generation and needs a new query.
    """

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", 128 << 20))

    def initialOffset(self):
        return {}

    def latestOffset(self):
        out = {}
        for name, size, _ in list_files(self.path):
            fs, _ = open_path(name)
            with fs.open_input_file(name) as f:
                end = size
                while end > 0:
                    start = max(0, end - 65536)
                    f.seek(start)
                    hit = f.read(end - start).rfind(b"\n")
                    if hit >= 0:
                        end = start + hit + 1
                        break
                    end = start
                head = min(PROOF, end)
                out[name] = {"end": end, "head_bytes": head, "head": digest_of(f, 0, head), "tail": digest_of(f, max(0, end - PROOF), end)}
        return out

    @staticmethod
    def same(name: str, known: dict) -> bool:
        fs, _ = open_path(name)
        with fs.open_input_file(name) as f:
            end = known["end"]
            return f.size() >= end and digest_of(f, 0, known["head_bytes"]) == known["head"] and digest_of(f, max(0, end - PROOF), end) == known["tail"]

    def partitions(self, start, end):
        out = []
        for name, known in start.items():
            if end.get(name, {"end": -1})["end"] < known["end"] or not self.same(name, known):
                raise ValueError(f"{name} was truncated, replaced or deleted: start a new query")
        for name, to in end.items():
            for at in range(start[name]["end"] if name in start else 0, to["end"], self.split):
                out.append(ByteRange(name, to["head"][:16], at, min(at + self.split, to["end"]), need_end=True))
        return out or [ByteRange("", "", 0, 0)]

    def read(self, partition):
        if partition.source:
            yield from batches(partition)

    def commit(self, end):
        pass


@dataclass
class PartReceipt(WriterCommitMessage):
    part: int
    records: int
    size: int
    sha256: str


DELIMITERS = {0: b"", 1: b"\n", 2: b"\r\n"}


class FramedWriter(DataSourceArrowWriter):
    """K1/K2: writes raw bytes and delimiters, one ordered file per partition, and a receipt."""

    def __init__(self, options: dict):
        self.path = options["path"]
        fs, root = open_path(self.path)
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            raise FileExistsError(self.path)

    def write(self, iterator):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        fs, root = open_path(self.path)
        fs.create_dir(root, recursive=True)
        name = f"{root}/_attempt-{part:06d}-{attempt}"
        digest, size, records = hashlib.sha256(), 0, 0
        with fs.open_output_stream(name) as f:
            for batch in iterator:
                for raw, delim in zip(batch.column("raw").to_pylist(), batch.column("delim_len").to_pylist()):
                    data = raw + DELIMITERS[delim]
                    f.write(data)
                    digest.update(data)
                    size, records = size + len(data), records + 1
        return PartReceipt(part, records, size, f"{digest.hexdigest()} {name}")

    def commit(self, messages):
        fs, root = open_path(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        for m in parts:
            fs.move(m.sha256.split(" ", 1)[1], f"{root}/part-{m.part:06d}.jsonl")
        receipt = {
            "records": sum(m.records for m in parts), "bytes": sum(m.size for m in parts),
            "parts": [{"part": m.part, "records": m.records, "bytes": m.size, "sha256": m.sha256.split(" ", 1)[0]} for m in parts],
        }
        with fs.open_output_stream(f"{root}/_receipt.json") as f:
            f.write(json.dumps(receipt).encode())

    def abort(self, messages):
        pass


class FramedText(DataSource):
    @classmethod
    def name(cls):
        return "framed_text"

    def schema(self):
        return COUNT_SCHEMA if self.options.get("mode") == "count" else SCHEMA

    def reader(self, schema):
        return FramedReader(dict(self.options))

    def streamReader(self, schema):
        return FramedStream(dict(self.options))

    def writer(self, schema, overwrite):
        return FramedWriter(dict(self.options))
