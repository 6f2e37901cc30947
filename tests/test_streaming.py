import os
import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.fixture import security_events, threats
from checks.queries import RULES_DIR
from ravelin.operators import alerts as A
from ravelin.operators.alerts import suppress
from ravelin.operators.evaluate import evaluate
from ravelin.operators.ingest import reject_reason
from ravelin.operators.rules import load_rules
from ravelin.plans.pipeline import enriched_events, run_pipeline, standard_enrichers
from ravelin.sources.decode import decode
from ravelin.sources.files import stream_parquet
from ravelin.streaming import jobs
from ravelin.streaming.processors import RING_BLOCK, OrderedProcessor, Ring, threshold_fold, window_fold
from tests import brute


def run_to_end(stream, folder, name):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(folder / f"checkpoint-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def as_files(df, folder, ts):
    """Five files in time order, so that the watermark moves between micro-batches."""
    path = str(folder / "in")
    df.repartitionByRange(5, ts).sortWithinPartitions(ts).write.parquet(path)
    for place, file in enumerate(sorted(Path(path).glob("*.parquet"))):
        os.utime(file, (1_700_000_000 + place, 1_700_000_000 + place))  # the source reads in file time order
    return path


def newest_passed(df, ts, delay_us):
    return df.agg(F.max(F.unix_micros(ts))).head()[0] - delay_us


def test_rules_stream_equals_batch(spark, sf_dir, tmp_path):
    ready = enriched_events(security_events(spark, sf_dir), standard_enrichers(threats(spark, sf_dir)))
    rules = load_rules(RULES_DIR)
    stored = spark.read.parquet(as_files(ready.drop("enrich_errors"), tmp_path, "timestamp"))
    stream = stream_parquet(spark, str(tmp_path / "in"), stored.schema, 1)
    got = run_to_end(jobs.stream_evaluate(stream, rules, "1 hour"), tmp_path, "rules_out")
    mark = newest_passed(stored, "timestamp", 3_600_000_000) // 1000 * 1000
    want = evaluate(stored, rules).filter((F.unix_micros("timestamp") <= mark) | F.col("rule_id").isin("listed-login", "root-shell"))
    columns = ["rule_id", "group_key", "event_id", "event_count", "severity"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert {"error-burst", "kill-chain", "listed-login"} <= {r.rule_id for r in got.select("rule_id").distinct().collect()}


def test_suppression_stream_equals_batch(spark, sf_dir, tmp_path):
    from checks.queries import error_alerts

    alerts = error_alerts(spark, sf_dir)
    stored = spark.read.parquet(as_files(alerts, tmp_path, "created_at"))
    stream = stream_parquet(spark, str(tmp_path / "in"), stored.schema, 1)
    got = run_to_end(jobs.stream_suppress(stream, "24h", "1 minute"), tmp_path, "suppress_out")
    mark = newest_passed(stored, "created_at", 60_000_000) // 1000 * 1000
    want = suppress(stored, "24h").filter(F.unix_micros("created_at") <= mark)
    assert sorted(map(tuple, got.select("alert_id", "kept").collect())) == sorted(map(tuple, want.select("alert_id", "kept").collect()))


def test_ingest_stream_equals_batch(spark, sf_dir, tmp_path):
    from checks.queries import arrivals

    rows = arrivals(spark, sf_dir).withColumn("arrival_ts", F.timestamp_micros("arrival_us"))
    stored = spark.read.parquet(as_files(rows, tmp_path, "arrival_ts"))
    stream = stream_parquet(spark, str(tmp_path / "in"), stored.schema, 1)
    got = run_to_end(jobs.stream_ingest(stream, delay="1 minute"), tmp_path, "ingest_out")
    mark = newest_passed(stored, "arrival_ts", 60_000_000) // 1000 * 1000
    want = reject_reason(stored).filter((F.col("arrival_us") <= mark) | (F.col("event_id") == ""))
    columns = ["event_id", "arrival_us", "reason"]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, got.select(columns).collect())) == sorted(map(key, want.select(columns).collect()))


def test_persist_and_deliver_batches(spark, sf_dir, tmp_path):
    from checks.queries import error_alerts

    events = security_events(spark, sf_dir)
    path = as_files(events, tmp_path, "timestamp")
    stream = stream_parquet(spark, path, spark.read.parquet(path).schema, 2)
    for run in ("a", "b"):  # the second query reads everything again and adds nothing
        query = stream.writeStream.foreachBatch(jobs.persist_batches(str(tmp_path / "table"))).option(
            "checkpointLocation", str(tmp_path / f"cp-{run}")
        ).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.count() == events.count() == table.select("event_id").distinct().count()

    write = jobs.deliver_batches([jobs.Channel("log")], lambda c, u, h, b: 200, str(tmp_path / "receipts"), str(tmp_path / "letters"))
    alerts = error_alerts(spark, sf_dir)
    write(alerts, 7)
    receipts = spark.read.parquet(str(tmp_path / "receipts"))
    assert receipts.filter("status = 'sent' AND batch_id = 7").count() == alerts.count()
    write(alerts.limit(1), 7)  # the same batch again replaces what it wrote
    assert spark.read.parquet(str(tmp_path / "receipts")).count() == 1
    encoded = table.select(F.col("raw_data").alias("value"), F.col("event_id").alias("stored_id"))
    again = decode(encoded).good
    assert again.count() == again.filter("event_id = stored_id").count() == events.count()


def test_late_rows_and_rows_without_time_are_judged(spark, tmp_path):
    """Every row comes out once, however late; rows without time too."""
    minute = 60_000_000
    days = [(f"e{i}", f"k{i % 3}", i * 100 * minute) for i in range(30)]
    late = [(f"l{i}", "k0", i * minute) for i in range(5)] + [("n", "k1", None)]
    end = [("end", "k9", 10**6 * minute), ("end2", "k9", 2 * 10**6 * minute)]
    path = tmp_path / "in"
    for place, rows in enumerate([days, late, end[:1], end[1:], [("end3", "k9", 3 * 10**6 * minute)]]):
        part = spark.createDataFrame(rows, "id string, k string, us long").select("id", "k", F.timestamp_micros("us").alias("at"))
        part.coalesce(1).write.mode("append").parquet(str(path))
        newest = max((f for f in path.glob("*.parquet")), key=lambda f: f.stat().st_ctime_ns)
        os.utime(newest, (1_700_000_000 + place, 1_700_000_000 + place))
    stream = stream_parquet(spark, str(path), spark.read.parquet(str(path)).schema, 1)
    marked = jobs.stream_first_per_window(stream, [F.col("k")], "at", "id", "1m", True, "1 minute")
    got = [r["id"] for r in run_to_end(marked, tmp_path, "late_out").collect()]
    assert len(got) == len(set(got)) and {*(r[0] for r in days), *(r[0] for r in late)} <= set(got)


def test_pipeline_stream_equals_batch(spark, sf_dir, tmp_path):
    events, listed, rules = security_events(spark, sf_dir), threats(spark, sf_dir), load_rules(RULES_DIR)
    stored = spark.read.parquet(as_files(events, tmp_path, "timestamp"))
    stream = stream_parquet(spark, str(tmp_path / "in"), stored.schema, 1)
    out = jobs.stream_pipeline(stream, rules, listed, delay="1 hour")
    got = run_to_end(out.alerts, tmp_path, "pipeline_out")
    mark = newest_passed(stored, "timestamp", 3_600_000_000) // 1000 * 1000
    want = run_pipeline(stored, rules, listed).alerts.filter((F.unix_micros("created_at") <= mark) | F.col("rule_id").isin("listed-login", "root-shell"))
    columns = ["alert_id", "rule_id", "severity", "description"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    severities = run_to_end(out.events.select("event_id", "severity"), tmp_path, "events_out")
    assert severities.count() == events.count()


@pytest.mark.parametrize("keys", [(), ("rule_id",)])
def test_decisions_stream_equals_batch(spark, sf_dir, tmp_path, keys):
    """Suppression and the rate limit over micro-batches, for one bucket and for one per rule; the last batch again."""
    from checks.queries import error_alerts

    alerts = error_alerts(spark, sf_dir).withColumn("rule_id", F.concat("rule_id", F.pmod(F.xxhash64("alert_id"), F.lit(3)).cast("string")))
    stored = spark.read.parquet(as_files(alerts, tmp_path, "created_at"))
    stream, limits = stream_parquet(spark, str(tmp_path / "in"), stored.schema, 1), {"keys": keys, "interval_micros": 6 * 3_600_000_000, "capacity": 2}
    out, state = str(tmp_path / "out"), str(tmp_path / "buckets")
    seen = []

    def sink(batch, batch_id):
        seen.append(batch_id)
        batch.select("alert_id", "decision").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    for again in (False, True):
        if again:  # as if the query had ended before the last batch was committed
            for name in (f"{seen[-1]}", f".{seen[-1]}.crc"):
                os.remove(tmp_path / "checkpoint" / "commits" / name)
        writer = jobs.stream_decide(stream, sink, state, "12h", "1 minute", **limits)
        query = writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    assert len(seen) > len(set(seen)) and len(jobs.batch_numbers(spark, state)) <= 3
    mark = newest_passed(stored, "created_at", 60_000_000) // 1000 * 1000
    want = A.decide(stored, "12h", **limits).filter(F.unix_micros("created_at") <= mark)
    want = sorted(map(tuple, want.select("alert_id", "decision").collect()))
    assert sorted(map(tuple, spark.read.parquet(out).select("alert_id", "decision").collect())) == want
    assert {d for _, d in want} == {A.SENT, A.SUPPRESSED, A.RATE_LIMITED}


class FakeMap:
    def __init__(self):
        self.rows, self.reads, self.bytes = {}, 0, 0

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        self.reads, self.bytes = self.reads + 1, self.bytes + len(self.rows[key][0])
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        self.rows.pop(key, None)

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows.clear()


class FakeValue(FakeMap):
    def get(self):
        return self.rows["value"]

    def update(self, value):
        self.rows["value"] = tuple(value)


class FakeHandle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, FakeMap())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, FakeValue())

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def driven(fold, batches, delay_us=1_000_000, end=10**9):
    """Runs the processor on plain objects, as the engine does: rows, then timers the watermark has passed."""
    processor = OrderedProcessor(lambda key: fold, fold.schema, ["key"], False, delay_us)
    handle, out, costs = FakeHandle(), [], []
    processor.init(handle)
    for mark, rows in [*batches, (end, []), (end + 10, [])]:
        if rows:
            frame = pd.DataFrame(rows, columns=["ts", "id", "steps", "payload"])
            list(processor.handleInputRows(("k",), iter([frame]), Clock(mark)))
        before = handle.states["waiting"].bytes
        for timer in sorted(t for t in handle.timers if t < mark):
            handle.timers.discard(timer)
            for frame in processor.handleExpiredTimer(("k",), Clock(mark), None):
                out += frame.id.tolist()
        costs.append(handle.states["waiting"].bytes - before)
    return out, costs, handle


@pytest.mark.parametrize("wanted", [1, 2, 5, 700, 1500])
def test_ring_equals_the_plain_threshold(wanted):
    rng = random.Random(wanted)
    rows = sorted((rng.randrange(3_000_000), f"e{i:05d}") for i in range(6_000))
    batches = [(rows[i + 199][0] // 1000, [(t, n, 1, None) for t, n in rows[i : i + 200]]) for i in range(0, len(rows), 200)]
    fired, _, handle = driven(threshold_fold(900_000, wanted), batches)
    assert sorted(fired) == brute.threshold([("k", *r) for r in rows], 900_000, wanted)
    assert not handle.states["ring"].rows and not handle.states["waiting"].rows and not handle.states["folded"].rows


def test_cost_of_a_high_threshold_is_flat():
    """A million arrivals of one key and a threshold of a million: blocks read and written per arrival stay constant."""
    store = FakeMap()
    fold, state, ring = threshold_fold(10**12, 300_000), (0, None), Ring(store)
    costs, fires = [], 0
    for i in range(1_000_000):
        state, fired = fold.step(state, i, 1, ring)
        fires += fired
        if (i + 1) % 100_000 == 0:
            ring.save()
            costs.append(ring.reads + ring.writes)
            ring = Ring(store)
    assert fires == 3 and max(costs) <= 2 * 100_000 / RING_BLOCK + 20 and len(store.rows) <= 300_000 / RING_BLOCK + 2


def test_a_timer_reads_what_is_due_and_not_what_waits():
    """Rows far ahead of the watermark wait unread, however many they are."""
    fold = window_fold(1_000, True)
    near = [(100 + i, [(100_000 * i + j, f"n{i}-{j}", 0, None) for j in range(5)]) for i in range(1, 30)]
    _, costs, _ = driven(fold, near)
    far = [(500_000_000 + i * 10_000, f"f{i}", 0, None) for i in range(20_000)]
    _, more, _ = driven(fold, [(1, far), *near])
    assert max(more[1 : len(near)]) <= max(costs) + 200


def test_null_ids_in_state(spark):
    rows = [(5_000, None, 0, None), (5_000, "a", 0, None), (5_000, None, 0, "p"), (4_000, None, 0, None)]
    fired, _, _ = driven(threshold_fold(10_000, 2), [(1, rows)])
    assert fired == ["", "a"]
