"""Cases that once gave wrong rows or ended a job."""

import random

import pytest
from pyspark.sql import functions as F

from ravelin.operators import alerts, analytics, delivery, metrics, ordered
from ravelin.operators.enrich import ip_range_enrich
from ravelin.operators.evaluate import evaluate
from ravelin.operators.rules import Condition, Rule
from ravelin.schema import normalise_events
from ravelin.sources.decode import decode, encode_json, encode_protobuf
from ravelin.sources.topics import ordered_per_host
from tests import brute

FAILURE = (Condition("type", "eq", "EVENT_TYPE_AUTH_FAILURE"),)


def failures(spark, rows):
    """rows: (event_id, host, microseconds or None)."""
    raw = spark.createDataFrame(rows, "event_id string, hostname string, us bigint")
    return normalise_events(raw.select("event_id", "hostname", F.timestamp_micros("us").alias("timestamp"), F.lit("EVENT_TYPE_AUTH_FAILURE").alias("type")))


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_events_without_time_count_on_every_path(spark, hot_rows):
    rows = [(f"e{i:02d}", "h", None if i % 4 == 0 else i * 1_000_000) for i in range(40)]
    rule = Rule("t", "t", "threshold", conditions=FAILURE, group_by=("hostname",), threshold=1, window_micros=1)
    assert evaluate(failures(spark, rows), [rule], hot_rows=hot_rows, chunk_rows=8).count() == 40


def test_a_burst_is_split(spark):
    rng = random.Random(1)
    rows = [("k", 5_000_000 + rng.randrange(1_000_000), f"b{i}") for i in range(2000)] + [("k", d * 86_400_000_000, f"d{d}") for d in range(21)]
    df = spark.createDataFrame(rows, "k string, ts bigint, id string")
    seen = []

    def keep(frame):
        seen.append(frame)
        return frame.checkpoint()

    plain, ordered.materialise = ordered.materialise, keep
    try:
        hot = ordered.hot_keys(df, ["k"], "ts", 100)
        ranked = ordered.rank_hot(df, ["k"], "ts", ["id"], hot, 100)
    finally:
        ordered.materialise = plain
    largest = max(f.groupBy("k", "slab").count().agg(F.max("count")).first()[0] for f in seen if "slab" in f.columns)
    assert largest <= 100
    want = {r[2]: n for n, r in enumerate(sorted(rows), 1)}
    assert {r["id"]: r["rn"] for r in ranked.collect()} == want


def test_slabs_stay_few_where_the_limit_is_low(spark, monkeypatch):
    rows = [("k" if i % 3 else None, i % 7, f"e{i:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "k string, ts bigint, id string").filter("k IS NOT NULL")
    parts, plain = [], ordered.materialise
    monkeypatch.setattr(ordered, "materialise", lambda f: (parts.append(f), plain(f))[1])
    hot = ordered.hot_keys(df, ["k"], "ts", 2)
    ranked = ordered.rank_hot(df, ["k"], "ts", ["id"], hot, 2)
    slabbed = [f for f in parts if "slab" in f.columns]
    assert len(slabbed) == 1 and 1 < slabbed[0].select("slab").distinct().count() <= ordered.SLABS
    want = {i: n for n, (_, i) in enumerate(sorted((t, i) for k, t, i in rows if k), 1)}
    assert {r["id"]: r["rn"] for r in ranked.collect()} == want
    assert ordered.slab_count(30_000_000, 500) * ordered.SLAB_ROWS <= 30_000_000 and ordered.slab_count(30_000_000, 2_000_000) == 30


def test_bursts_and_null_times_in_windows(spark):
    rng = random.Random(2)
    rows = [("hot", None if i % 50 == 0 else 10**9 + rng.randrange(3_000_000), f"e{i:04d}") for i in range(400)] + [("hot", i * 10**8, f"s{i:02d}") for i in range(30)]
    df = spark.createDataFrame(rows, "k string, ts bigint, id string")
    want = brute.first_per_window([(k, t or 0, i) for k, t, i in rows], 50_000, True)
    for hot_rows in (None, 60):
        out = ordered.first_per_window(df, ["k"], "ts", ["id"], 50_000, True, "kept", hot_rows, 20)
        assert sorted(r["id"] for r in out.filter("kept").collect()) == want and out.count() == len(rows)


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds = []

    def counted(n):
        count = [0]
        monkeypatch.setattr(ordered, "materialise", lambda f: (count.__setitem__(0, count[0] + 1), f.checkpoint())[1])
        nodes = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("start_a"), F.col("id").alias("start_b"), (F.col("id") + 4).alias("reach_a"), F.lit(ordered.FAR).alias("reach_b"))
        taken = sorted(r["start_a"] for r in ordered._jump(nodes, ["k"]).collect())
        assert taken == list(range(0, n, 5))
        rounds.append(count[0])

    counted(50)
    counted(500)
    assert rounds[1] - rounds[0] <= 3 * 4


def test_copies_and_empty_ids(spark):
    rows = [("", "a", 1), ("", "b", 2), ("", "a", 1), ("x", "a", 5), ("x", "a", 5), ("x", "a", 9), ("x", "b", 5)]
    single = Rule("s", "s", "single", conditions=FAILURE, group_by=("hostname",))
    each = Rule("t", "t", "threshold", conditions=FAILURE, group_by=("hostname",), threshold=1, window_micros=10)
    for hot_rows in (None, 2):
        out = evaluate(failures(spark, rows), [single, each], dedup=True, hot_rows=hot_rows, chunk_rows=2)
        assert {r[0]: r[1] for r in out.groupBy("rule_id").count().collect()} == {"s": 6, "t": 6}


def test_one_scan_and_a_compiled_match(spark, tmp_path):
    failures(spark, [("x", "a", 5)]).write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    rules = [Rule("s", "s", "single", conditions=FAILURE), Rule("t", "t", "threshold", conditions=FAILURE, group_by=("hostname",), threshold=2, window_micros=10)]
    plan = evaluate(events, rules, dedup=True, hot_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "lambda" not in plan.split("FileScan")[1] and plan.count("Exchange") == 1


def test_a_column_named_bucket_is_a_key_like_others(spark):
    df = spark.createDataFrame([("a", 0, "1"), ("a", 0, "2"), ("a", 0, "3"), ("b", 0, "4"), ("b", 0, "5")], "bucket string, ts bigint, id string")
    got = alerts.token_bucket(df, "ts", "id", 1000, 2, ["bucket"])
    assert sorted(tuple(r) for r in got.select("bucket", "id").filter("allowed").collect()) == [("a", "1"), ("a", "2"), ("b", "4"), ("b", "5")]
    assert alerts.token_bucket(df, "ts", "id", 1000, 2).filter("allowed").count() == 2


def test_large_counts_have_a_baseline(spark):
    hour = 3_600_000_000
    counts = spark.createDataFrame([("h", i, 3_000_000_000 + i % 2) for i in range(6)] + [("h", 6, 3_000_000_900)], "h string, b bigint, n bigint")
    # the operator counts events; weights are not needed to see that sums of squares stay exact
    rows = spark.createDataFrame([("h", b * hour + j) for b, n in [(0, 5), (1, 6), (2, 5), (3, 6), (4, 40)] for j in range(n)], "h string, ts bigint")
    (found,) = analytics.baseline_anomalies(rows, ["h"], "ts", "1h", 4, 3.0).collect()
    assert (found["bucket"], found["events"], found["mean"]) == (4, 40, 5.5) and abs(found["deviation"] - 3**-0.5) < 1e-12
    assert counts.count() == 7


def test_null_observations_and_rank_zero(spark):
    obs = spark.createDataFrame([("a", None), ("a", 0.3)], "k string, v double")
    buckets = metrics.bucketize(obs, ["k"], "v", (0.1, 0.5))
    assert {r["le"]: r["count"] for r in buckets.collect()} == {0.1: 0, 0.5: 1, metrics.INFINITE: 1}
    assert metrics.histogram_quantile(buckets, ["k"], 0.0).first()["quantile"] == 0.0


def test_severities_without_target_stay(spark):
    df = spark.createDataFrame([("A", 5), ("A", 50), ("B", 1)], "severity string, delay_us bigint")
    assert sorted(map(tuple, analytics.sla_compliance(df, {"A": 10}).collect())) == [("A", 2, 1, 0.5), ("B", 1, None, None)]


def test_the_narrowest_range_counts_once(spark):
    events = failures(spark, [("x", "a", 5)]).withColumn("source_ip", F.lit("9.1.2.3"))
    ranges = spark.createDataFrame([("9.0.0.0", "9.255.255.255", "WIDE", "c", 1), ("9.1.2.0", "9.1.2.255", "NEAR", "c", 2)], "first_ip string, last_ip string, country string, city string, asn long")
    (row,) = ip_range_enrich(events, ranges).collect()
    assert row["metadata"]["geo_country"] == "NEAR"


def test_the_log_channel_never_fails(spark):
    tasks = spark.createDataFrame([("a", "log", "p", "", {})], "alert_id string, channel string, payload string, url string, headers map<string,string>")

    def send(*_):
        raise RuntimeError("down")

    done, dead = delivery.deliver(tasks, send, attempts=1, pause=lambda _: None)
    assert done.first()["status"] == "sent" and dead.count() == 0


def test_events_that_leave_out_their_id(spark):
    df = spark.createDataFrame([('{"hostname":"h"}',), ("{broken",), ("null",), ('{"event_id":"x"}',)], "value string")
    out = decode(df)
    assert sorted((r["event_id"], r["hostname"], r["type"]) for r in out.good.collect()) == [("", "h", "EVENT_TYPE_UNSPECIFIED"), ("x", "", "EVENT_TYPE_UNSPECIFIED")]
    assert sorted(r[0] for r in out.malformed.collect()) == ["null", "{broken"]


def test_unknown_enum_text_is_split_off(spark):
    events = failures(spark, [("x", "a", 5), ("y", "a", 5), ("z", "a", 5)])
    odd = events.withColumn("type", F.when(F.col("event_id") == "x", "42").when(F.col("event_id") == "y", "NO_SUCH").otherwise(F.col("type")))
    assert {r["event_id"]: r["value"] is None for r in encode_protobuf(odd).collect()} == {"x": False, "y": True, "z": False}
    assert encode_json(events).count() == 3


def test_order_per_host(spark):
    events = failures(spark, [(f"e{i}", f"h{i % 3}", (i * 7919) % 500 * 3_600_000_000) for i in range(300)])
    seen = {}
    for part in ordered_per_host(events).select("hostname", "timestamp", F.spark_partition_id().alias("p")).collect():
        seen.setdefault(part["hostname"], []).append((part["p"], part["timestamp"]))
    assert all(len({p for p, _ in v}) == 1 and v == sorted(v) for v in seen.values())


def test_all_alerts_have_a_place(spark):
    df = spark.createDataFrame([(f"a{i:03d}", f"SEVERITY_{['LOW', 'HIGH', 'CRITICAL'][i % 3]}", 1000 - i) for i in range(200)], "alert_id string, severity string, at long").withColumn("created_at", F.timestamp_micros("at"))
    rows = alerts.by_priority(df).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, 201))
    rank = {"SEVERITY_CRITICAL": 0, "SEVERITY_HIGH": 1, "SEVERITY_LOW": 2}
    assert [r["alert_id"] for r in rows] == [r["alert_id"] for r in sorted(rows, key=lambda r: (rank[r["severity"]], r["at"], r["alert_id"]))]


def test_malformed_protobuf_rows_are_told_without_their_fields(spark):
    values = [(1, b""), (2, b"\x0a\xff\x01"), (3, None), (4, b"\x0a\x01x")]
    out = decode(spark.createDataFrame(values, "n int, value binary"), encoding="protobuf")
    assert sorted(r["n"] for r in out.malformed.collect()) == [2, 3] and sorted(r["n"] for r in out.good.collect()) == [1, 4]
    assert "decoded" not in out.malformed._jdf.queryExecution().analyzed().toString()
