"""The agent's work on a stream against the batch operators."""

import time

import pandas as pd
from pyspark.sql import functions as F

from ravelin.operators.processes import process_diff
from ravelin.sources.files import stream_parquet
from ravelin.streaming.agents import BatchProcessor, stream_batches, stream_process_diff
from tests.test_streaming import FakeHandle, FakeValue, as_files, newest_passed, run_to_end


def test_process_changes_stream_equals_batch(spark, sf_dir, tmp_path):
    from checks.queries import snapshots

    stored = spark.read.parquet(as_files(snapshots(spark, sf_dir), tmp_path, "snapshot_ts"))
    stream = stream_parquet(spark, str(tmp_path / "in"), stored.schema, 1)
    got = run_to_end(stream_process_diff(stream, "1 minute", "a"), tmp_path, "process_out")
    mark = newest_passed(stored, "snapshot_ts", 60_000_000)
    want = process_diff(stored, "a").filter(F.unix_micros("timestamp") < mark)
    columns = ["event_id", "type", "timestamp", "hostname", "process", "agent_id"]
    rows = sorted(map(tuple, got.select(columns).collect()))
    assert rows == sorted(map(tuple, want.select(columns).collect())) and {r[1] for r in rows} == {"EVENT_TYPE_PROCESS_START", "EVENT_TYPE_PROCESS_STOP"}


class FakeList(FakeValue):
    def put(self, rows):
        self.rows["value"] = list(rows)

    def get(self):
        return iter(self.rows.get("value", []))


class ListHandle(FakeHandle):
    def getListState(self, name, *_):
        return self.states.setdefault(name, FakeList())


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_batches_leave_full_or_at_a_tick():
    handle, processor, out = ListHandle(), BatchProcessor(3, 5_000), []
    processor.init(handle)

    def came(now, names):
        for frame in processor.handleInputRows(("a",), iter([pd.DataFrame({"event": names})]), Clock(now)):
            out.extend(zip(frame.sequence.tolist(), frame.event.tolist()))

    def passed(now):
        for timer in sorted(t for t in handle.timers if t <= now):
            handle.timers.discard(timer)
            for frame in processor.handleExpiredTimer(("a",), Clock(now), None):
                out.extend(zip(frame.sequence.tolist(), frame.event.tolist()))

    came(1_000, ["1", "2"])
    came(3_000, ["3", "4"])  # full: the tick is not moved
    assert out == [(1, "1"), (1, "2"), (1, "3")] and handle.timers == {6_000}
    passed(6_000)
    assert out[3:] == [(2, "4")]
    passed(11_000)
    came(12_000, list("abcdefg"))
    assert out[4:] == [(3, "a"), (3, "b"), (3, "c"), (4, "d"), (4, "e"), (4, "f")] and handle.timers == {16_000}
    passed(16_500)
    assert out[-1] == (5, "g") and not handle.timers


def test_batches_on_a_stream(spark, tmp_path):
    rows = spark.range(25).select(F.when(F.col("id") % 2 == 0, "a").alias("agent_id"), "id", F.timestamp_seconds("id").alias("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_batches(stream_parquet(spark, str(tmp_path / "in"), rows.schema), 5, "1s")
    query = stream.writeStream.format("memory").queryName("batches_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 120
        while spark.table("batches_out").count() < 25 and time.time() < until:
            time.sleep(1)
        assert query.exception() is None
    finally:
        query.stop()
    found = spark.table("batches_out").groupBy("agent_id", "sequence").agg(F.count("*").alias("n"), F.min("timestamp").alias("t")).collect()
    assert sorted((r["agent_id"] or "", r["sequence"], r["n"]) for r in found) == [("", 1, 5), ("", 2, 5), ("", 3, 2), ("a", 1, 5), ("a", 2, 5), ("a", 3, 3)]
    assert all(r["t"] is not None for r in found)
