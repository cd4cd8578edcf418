"""Shared helpers: the documents table, written stages, and cached splitting of text."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomrecord.session import scratch_dir

#: Words are runs of anything but these characters (fixed by the contracts).
WORD_SQL = r"[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared scratch folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    target = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def words_of(text: str | None) -> list[bytes]:
    """ASCII white space (space, 09-0D) separates words; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., dict]], step: int = 512) -> DataFrame:
    """Run a batch function over the chosen columns, in slices of `step` rows.

    `make()` is called once per task and gives a function from column lists to a
    dict of result columns.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, target = None, None
        for batch in batches:
            fn = fn or make()
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                out = fn(*(part.column(j).to_pylist() for j in range(part.num_columns)))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(arrow))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = list(to_arrow_schema(_parse_datatype_string(schema)))
    return df.select(*columns).mapInArrow(run, schema)


#: A space inside or at the end of a run of white space: splitting before it could change the matches around it.
_IN_RUN = re.compile(r"\s (?=\s|\Z)")


class ChunkCache:
    """Text to one value per chunk, where chunks start at single spaces.

    The GPT-style pattern never matches across a space unless white space stands on
    both sides of it, so a text is cut there and each distinct chunk is encoded once
    per worker. `encode(list of chunks)` gives a value per chunk. Beyond `limit` chunks
    the cache starts anew and keeps what it had as a second generation until the next
    time; that changes speed, never results.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 400_000):
        self.encode, self.limit, self.first, self.rest, self.old = encode, limit, {}, {}, {}

    @staticmethod
    def safe(text: str) -> bool:
        return _IN_RUN.search(text) is None

    def values(self, texts: list[str]) -> list[list]:
        """Values of each text's chunks in order; every text must be safe()."""
        if len(self.first) + len(self.rest) > self.limit:
            self.first, self.rest, self.old = {}, {}, self.rest
        split = [t.split(" ") for t in texts]
        rest, first = self.rest, self.first
        new_rest = {c for s in split for c in s[1:] if c not in rest}
        new_first = {s[0] for s in split if s[0] not in first}
        if self.old and new_rest:
            again = new_rest & self.old.keys()
            rest.update((c, self.old[c]) for c in again)
            new_rest -= again
        if new_rest:
            new = list(new_rest)
            rest.update(zip(new, self.encode([" " + c for c in new])))
        if new_first:
            new = list(new_first)
            first.update(zip(new, self.encode(new)))
        return [[first[s[0]], *map(rest.__getitem__, s[1:])] for s in split]
