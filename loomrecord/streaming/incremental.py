"""Structured Streaming forms: counts, buckets, normalising and relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_categories(events: DataFrame, dimension: str, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts per window and value; state is dropped behind the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), F.col(dimension).alias("label")).agg(F.count(F.lit(1)).alias("count")).select(
        F.unix_millis("w.start").alias("start_ms"), "label", "count")


def stream_problems(records: DataFrame) -> DataFrame:
    """Stateless problem rows of a stream of classified records."""
    return records.select("source_id", "ordinal", F.explode("problems").alias("p")).select("source_id", "ordinal", "p.code", "p.severity")


EDGES = "source_id string, profile_id string, kind string, stable_id string, source_key bigint, target_key bigint"
KEYS = ["source_id", "profile_id", "space", "id"]
RECORD = ["source_id", "profile_id", "ordinal"]
# Uses of an id, in the order in which one record makes them.
MEMBER, MESSAGE, SUBAGENT, PARENT, CALL, RESULT = range(6)


def id_uses(events: DataFrame) -> DataFrame:
    """One row per use of an id by a record; `late` marks children that are subagents themselves."""
    def use(col: str, space: str, code: int, when=None):
        test = F.col(col).isNotNull() if when is None else F.col(col).isNotNull() & when
        return F.when(test, F.struct(F.lit(space).alias("space"), F.col(col).alias("id"), F.lit(code).alias("use")))
    kind = F.col("event_kind")
    uses = F.array_compact(F.array(
        use("session_id", "session", MEMBER), use("turn_id", "turn", MEMBER), use("message_id", "node", MESSAGE), use("subagent_id", "node", SUBAGENT),
        use("parent_id", "node", PARENT), use("tool_call_id", "tool", CALL, kind.isin("tool_call", "action")),
        use("tool_call_id", "tool", RESULT, kind.isin("tool_result", "observation"))))
    return events.select("source_id", "profile_id", "ordinal", (F.coalesce(kind, F.lit("")) == "subagent").alias("late"), F.explode(uses).alias("u")).select("source_id", "profile_id", "u.*", "ordinal", "late")


class Correlator(StatefulProcessor):
    """Relations of the ids of one bucket. What an id has seen lies in the state store under its own key, lists of ordinals in parts that are read one by one.

    Only ids of the batch are looked up, each once. Of a batch, one bucket's uses are held,
    so that they can be put into record order; triggers bound them (maxBytesPerTrigger and the like).
    """

    CHUNK = 100_000
    PART = 1_000  # ordinals in one entry of a list
    HEAD = ["anchor", "message", "subagent", "calls", "results", "waiting"]  # three ordinals, then the number of parts of each list

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        own = "source_id string, profile_id string, space string, id string"
        self.ids = handle.getMapState("ids", own, ", ".join(f"{h} bigint" for h in self.HEAD), self.ttl_ms)
        self.lists = handle.getMapState("lists", f"{own}, list string, part bigint", "at array<bigint>, late array<boolean>", self.ttl_ms)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        uses = pd.concat(list(rows), ignore_index=True)
        at, use, late = uses["ordinal"].to_numpy(np.int64), uses["use"].to_numpy(np.int8), uses["late"].to_numpy(bool)
        which = uses.groupby(KEYS, sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((use, at, which))
        at, use, late, which = at[order], use[order], late[order], which[order]
        starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        names = [tuple(None if pd.isna(x) else x for x in k) for k in uses[KEYS].iloc[order[starts]].itertuples(index=False, name=None)]
        out, held = [], 0
        for own, i, j in zip(names, starts.tolist(), [*starts[1:].tolist(), len(at)]):
            for kind, a, b in self._edges(own, at[i:j], use[i:j], late[i:j]):
                if len(b):
                    out.append((own, kind, a, b))
                    held += len(b)
                if held >= self.CHUNK:
                    yield self._frame(out)
                    out, held = [], 0
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        sizes = [len(b) for *_, b in out]
        def each(values: list) -> np.ndarray:
            return np.repeat(np.array(values, object), sizes)
        return pd.DataFrame({"source_id": each([k[0] for k, *_ in out]), "profile_id": each([k[1] for k, *_ in out]), "kind": each([kind for _, kind, *_ in out]), "stable_id": each([k[3] for k, *_ in out]),
                             "source_key": np.concatenate([a for *_, a, _ in out]), "target_key": np.concatenate([b for *_, b in out])})

    def _edges(self, own: tuple, at: np.ndarray, use: np.ndarray, late: np.ndarray):
        known = self.ids.getValue(own)
        head = dict(zip(self.HEAD, known or (None, None, None, 0, 0, 0)))
        before = dict(head)
        space = own[2]
        yield from self._members(head, space, at) if space in ("session", "turn") else self._pairs(own, head, at[use == CALL], at[use == RESULT]) if space == "tool" else self._parents(own, head, at, use, late)
        if head != before:
            self.ids.updateValue(own, tuple(head[h] for h in self.HEAD))

    def _members(self, head: dict, space: str, at: np.ndarray):
        if head["anchor"] is None:
            head["anchor"] = int(at[0])
        anchor = head["anchor"]
        for i in range(0, len(at), self.CHUNK):
            part = at[i:i + self.CHUNK]
            part = part[part != anchor]
            yield f"{space}_member", np.full(len(part), anchor), part

    def _seen(self, own: tuple, head: dict, name: str) -> Iterator[tuple]:
        """A list of the state, part by part."""
        for n in range(head[name]):
            part = self.lists.getValue((*own, name, n))
            if part is not None:
                yield np.array(part[0], np.int64), np.array(part[1], bool)

    def _append(self, own: tuple, head: dict, name: str, at: np.ndarray, late: np.ndarray) -> None:
        for i in range(0, len(at), self.PART):
            self.lists.updateValue((*own, name, head[name]), (at[i:i + self.PART].tolist(), late[i:i + self.PART].tolist()))
            head[name] += 1

    def _pairs(self, own: tuple, head: dict, calls: np.ndarray, results: np.ndarray):
        """Each call with each result, as soon as the later of both is there."""
        for name, new, flip in (("results", calls, False), ("calls", results, True)):
            if len(new):
                for old, _ in self._seen(own, head, name):
                    for one in new.tolist():
                        yield "tool_pair", *((old, np.full(len(old), one)) if flip else (np.full(len(old), one), old))
        for one in calls.tolist():
            yield "tool_pair", np.full(len(results), one), results
        for name, new in (("calls", calls), ("results", results)):
            self._append(own, head, name, new, np.zeros(len(new), bool))

    def _parents(self, own: tuple, head: dict, at: np.ndarray, use: np.ndarray, late: np.ndarray):
        """A child takes the latest message, else the latest subagent of its id up to itself; without any it waits for the first that comes."""
        def latest(code: int, name: str):
            known = -1 if head[name] is None else head[name]
            return np.maximum.accumulate(np.r_[known, np.where(use == code, at, -1)])[1:] if known < 0 else np.where(
                (last := np.maximum.accumulate(np.where(use == code, np.arange(len(at)), -1))) < 0, known, at[last])
        message, subagent = latest(MESSAGE, "message"), latest(SUBAGENT, "subagent")
        child = use == PARENT
        owner = np.where(message >= 0, message, subagent)
        yield "parent_child", owner[child & (owner >= 0)], at[child & (owner >= 0)]
        open_ = child & (owner < 0)
        writers = np.flatnonzero((use == MESSAGE) | (use == SUBAGENT))
        if len(writers):
            first, by_subagent = int(at[writers[0]]), use[writers[0]] == SUBAGENT
            for child_at, child_late in self._seen(own, head, "waiting"):
                for kind, mine in (("subagent_parent", child_late | by_subagent), ("parent_child", ~child_late & (not by_subagent))):
                    yield kind, np.full(int(mine.sum()), first), child_at[mine]
            for n in range(head["waiting"]):
                self.lists.removeKey((*own, "waiting", n))
            head["waiting"] = 0
            for kind, mine in (("subagent_parent", open_ & (late | by_subagent)), ("parent_child", open_ & ~late & ~by_subagent)):
                yield kind, np.full(int(mine.sum()), first), at[mine]
            for code, name, last in ((MESSAGE, "message", message), (SUBAGENT, "subagent", subagent)):
                if (use == code).any():
                    head[name] = int(last[-1])
        elif open_.any():
            self._append(own, head, "waiting", at[open_], late[open_])


def stream_relations(events: DataFrame, keep: str | None = None, ttl_ms: int | None = None, buckets: int = 4096) -> DataFrame:
    """Relations of a stream of events, each once; children that come before their parent wait in state.

    A record that is delivered again is dropped before anything else. State is kept per
    (source, profile, id) in RocksDB, so it spreads over the cluster like the ids do and
    does not have to fit in memory. Ids are dealt to `buckets` by hash, so that one call
    serves many ids; the number may not change while a checkpoint lives. With `keep` (such as "2 days", by the events' `ts`)
    repeats are only looked for that long, and with `ttl_ms` an id that was not written
    for that long is forgotten (availableNow then needs
    spark.sql.streaming.noDataMicroBatches.enabled off); without them nothing expires. Within a trigger records
    are taken by ordinal, across triggers as delivered.
    """
    import loomrecord.streaming.incremental as here

    cloudpickle.register_pickle_by_value(here)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    once = events.withWatermark("ts", keep).dropDuplicatesWithinWatermark(RECORD) if keep else events.dropDuplicates(RECORD)
    dealt = id_uses(once).withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(Correlator(ttl_ms), EDGES, "append", "None" if ttl_ms is None else "ProcessingTime")
