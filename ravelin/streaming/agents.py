"""What an agent does on a stream: process changes from snapshots, and batches by size or by tick.

Both keep their state by key and go on after a restart of the query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ravelin.functions.durations import duration_micros
from ravelin.functions.times import micros
from ravelin.operators.processes import change_events, process_name
from ravelin.streaming.jobs import JSON_TIMES, use_state_store
from ravelin.streaming.processors import SLOT_KEY, TEXT

START, STOP = "EVENT_TYPE_PROCESS_START", "EVENT_TYPE_PROCESS_STOP"


class SnapshotProcessor(StatefulProcessor):
    """Compares a host's snapshots in time order, each once the watermark has passed it. The last snapshot is kept as a
    map of pid to command; rows of a snapshot that come after it was compared change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", SLOT_KEY, TEXT)  # snapshot time to its processes
        self.times = handle.getValueState("times", TEXT)
        self.last = handle.getValueState("last", T.StructType([T.StructField("ts", T.LongType()), T.StructField("processes", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, dict] = {}
        for frame in rows:
            for ts, pid, process in zip(frame.ts.tolist(), frame.pid.tolist(), frame.process.tolist()):
                fresh.setdefault(int(ts), {})[str(int(pid))] = process
        compared = self.last.get()[0] if self.last.exists() else None
        known = json.loads(self.times.get()[0]) if self.times.exists() else []
        for ts, processes in fresh.items():
            if compared is not None and ts <= compared:
                continue
            if ts in known:
                processes = json.loads(self.waiting.getValue((ts,))[0]) | processes
            else:
                known.append(ts)
                self.handle.registerTimer(ts // 1000 + 1)
            self.waiting.updateValue((ts,), (json.dumps(processes),))
        if known:
            self.times.update((json.dumps(sorted(known)),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        known = json.loads(self.times.get()[0]) if self.times.exists() else []
        out = []
        while known and known[0] < mark:
            ts = known.pop(0)
            now = json.loads(self.waiting.getValue((ts,))[0])
            self.waiting.removeKey((ts,))
            if self.last.exists():
                before = json.loads(self.last.get()[1])
                out += [(START, key[0], ts, int(pid), name) for pid, name in now.items() if pid not in before]
                out += [(STOP, key[0], ts, int(pid), name) for pid, name in before.items() if pid not in now]
            self.last.update((ts, json.dumps(now)))
        if known:
            self.times.update((json.dumps(known),))
        elif self.times.exists():
            self.times.clear()
        if out:
            yield pd.DataFrame(out, columns=["type", "host", "ts", "pid", "process"])

    def close(self) -> None:
        pass


def stream_process_diff(snapshots: DataFrame, delay: str = "1 minute", agent_id: str = "") -> DataFrame:
    """The events of ``process_diff`` over a stream of ``(host, snapshot_ts, pid, cmdline)``. A snapshot is compared
    with the one before it when the watermark has passed it. A null host, time or pid is no process."""
    use_state_store(snapshots.sparkSession)
    rows = snapshots.filter("host IS NOT NULL AND snapshot_ts IS NOT NULL AND pid IS NOT NULL").withWatermark("snapshot_ts", delay)
    rows = rows.select("host", micros(F.col("snapshot_ts")).alias("ts"), F.col("pid").cast("long").alias("pid"), process_name(F.col("cmdline"), F.col("pid")).alias("process"))
    out = "type string, host string, ts long, pid long, process string"
    found = rows.groupBy("host").transformWithStateInPandas(SnapshotProcessor(), out, "Append", "EventTime")
    return change_events(found.select("type", F.timestamp_micros("ts").alias("timestamp"), "host", "pid", "process"), agent_id)


class BatchProcessor(StatefulProcessor):
    """Gathers an agent's events: a batch leaves when it is full, and what is there leaves at each tick of the clock.
    Ticks fall on multiples of the interval since the agent's first event and are not moved by a full batch."""

    def __init__(self, size: int, interval_ms: int) -> None:
        self.size, self.interval = size, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gathered = handle.getListState("gathered", TEXT)
        self.place = handle.getValueState("place", T.StructType([T.StructField("sequence", T.LongType()), T.StructField("began", T.LongType()), T.StructField("held", T.LongType())]))

    def _state(self, now: int) -> tuple[int, int, int]:
        return tuple(int(x) for x in self.place.get()) if self.place.exists() else (0, now, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        sequence, began, held = self._state(now)
        waiting = [row[0] for row in self.gathered.get()] if held else []
        out = []
        for frame in rows:
            waiting += frame.event.tolist()
            while len(waiting) >= self.size:
                sequence += 1
                out += [(key[0], sequence, event) for event in waiting[: self.size]]
                waiting = waiting[self.size :]
        if waiting:
            self.gathered.put([(event,) for event in waiting])
            self.handle.registerTimer(began + ((now - began) // self.interval + 1) * self.interval)
        elif held:
            self.gathered.clear()
        self.place.update((sequence, began, len(waiting)))
        if out:
            yield pd.DataFrame(out, columns=["agent_id", "sequence", "event"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sequence, began, held = self._state(timerValues.getCurrentProcessingTimeInMs())
        if held:
            waiting = [row[0] for row in self.gathered.get()]
            self.gathered.clear()
            self.place.update((sequence + 1, began, 0))
            yield pd.DataFrame([(key[0], sequence + 1, event) for event in waiting], columns=["agent_id", "sequence", "event"])

    def close(self) -> None:
        pass


def stream_batches(events: DataFrame, size: int = 100, interval: str = "5s") -> DataFrame:
    """Events with ``sequence``, the number of their batch, from 1 per agent: a batch leaves with ``size`` events, or at
    the next tick of the clock with those there are. A null agent is one of its own."""
    size = size if size > 0 else 100
    span = duration_micros(interval) // 1000
    use_state_store(events.sparkSession)
    columns = [c for c in events.columns if c != "agent_id"]
    schema = T.StructType([events.schema[c] for c in columns])
    rows = events.select("agent_id", F.to_json(F.struct(*columns), JSON_TIMES).alias("event"))
    processor = BatchProcessor(size, span if span > 0 else 5_000)
    found = rows.groupBy("agent_id").transformWithStateInPandas(processor, "agent_id string, sequence long, event string", "Append", "ProcessingTime")
    back = found.select("agent_id", "sequence", F.from_json("event", schema, JSON_TIMES).alias("e"))
    return back.select(*[F.col("agent_id") if c == "agent_id" else F.col(f"e.`{c}`").alias(c) for c in events.columns], "sequence")
