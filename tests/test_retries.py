"""Deliveries that wait for their next attempt in state."""

import json
import time

import pandas as pd
from pyspark.sql import functions as F

from ravelin.operators import delivery as D
from ravelin.sources.files import stream_parquet
from ravelin.streaming.retries import RetryProcessor, stream_deliver
from tests.test_agents import Clock
from tests.test_streaming import FakeHandle


def steps(send, delays, until=100_000, tasks=1):
    handle, processor, out = FakeHandle(), RetryProcessor(send, delays, 50_000), []
    processor.init(handle)
    frame = pd.DataFrame({"task": [json.dumps({"url": "http://x", "headers": {"a": "b"}, "payload": "p"})] * tasks})
    for given in processor.handleInputRows(("a1", "hook"), iter([frame]), Clock(0)):
        out += given.to_dict("records")
    waits = []
    while handle.timers and min(handle.timers) <= until:
        now = min(handle.timers)
        waits.append(now)
        handle.timers.discard(now)
        for given in processor.handleExpiredTimer(("a1", "hook"), Clock(now), None):
            out += given.to_dict("records")
    return out, waits, handle


def test_attempts_follow_the_plan():
    calls = []

    def send(channel, url, headers, body):
        calls.append((channel, url, headers, body))
        return 500 if len(calls) < 3 else 200

    out, waits, handle = steps(send, [500, 1_000], tasks=2)
    assert calls == [("hook", "http://x", {"a": "b"}, "p")] * 3
    assert [(r["status"], r["attempts"], r["error"]) for r in out] == [(D.SENT, 3, "")]
    assert 375 <= waits[0] < 625 and 750 <= waits[1] - waits[0] < 1_250
    assert not handle.states["pending"].rows and not handle.states["settled"].rows  # forgotten after a while


def test_spent_attempts_make_a_dead_letter():
    def send(*_):
        raise RuntimeError("down")

    out, _, _ = steps(send, [1, 1])
    assert [(r["status"], r["attempts"], r["error"]) for r in out] == [(D.DLQ, 3, "max retry attempts reached: down")]


def test_a_dead_channel_delays_no_other(spark, tmp_path):
    alerts = spark.range(12).select(F.concat(F.lit("a"), "id").alias("alert_id"), F.concat(F.lit("p"), "id").alias("payload"))
    channels = [D.Channel("good", "http://good"), D.Channel("dead", "http://dead"), D.Channel("log")]
    tasks = D.delivery_tasks(alerts, channels)
    tasks.write.parquet(str(tmp_path / "in"))

    def send(channel, url, headers, body):
        if channel == "dead":
            raise RuntimeError("down")
        return 200

    stream = stream_deliver(stream_parquet(spark, str(tmp_path / "in"), tasks.schema), send, base_ms=4_000)
    query = stream.writeStream.format("memory").queryName("receipts_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 150
        early = None
        while spark.table("receipts_out").count() < 36 and time.time() < until:
            seen = {r["channel"] for r in spark.table("receipts_out").select("channel").distinct().collect()}
            early = early or (seen if seen else None)
            time.sleep(0.5)
        assert query.exception() is None
    finally:
        query.stop()
    assert early == {"good", "log"}
    columns = ["alert_id", "channel", "payload", "status", "error", "attempts"]
    want, letters = D.deliver(tasks, send, base_ms=1, pause=lambda _: None)
    got = spark.table("receipts_out")
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert D.dead_letters(got).count() == letters.count() == 12
