import hashlib
import hmac
import ipaddress
import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from ravelin.functions.maps import upsert
from ravelin.functions.net import is_private_or_loopback
from ravelin.functions.signing import hmac_sha256
from ravelin.functions.times import instant, parse_rfc3339, rfc3339
from ravelin.operators import alerts as A
from ravelin.operators import delivery, metrics, persist
from ravelin.operators.batches import assign_batches
from ravelin.operators.enrich import DEFAULT_THREATS, default_threats, enrich, geo_enrich, guarded, threat_enrich
from ravelin.operators.ingest import ingest
from ravelin.operators.logs import parse_log_lines
from ravelin.operators.processes import process_diff
from ravelin.operators.severity import classify_severity
from ravelin.plans.replay import replay
from ravelin.schema import ALERT_SCHEMA, DEAD_LETTER_SCHEMA, normalise_events
from ravelin.sources import topics
from ravelin.sources.decode import decode, encode_protobuf
from ravelin.sources.files import read_log_lines, write_alerts
from tests import brute


def test_log_lines(spark):
    lines = [
        "Mar 16 10:30:45 h sshd[12]: Failed password for root from 1.2.3.4 port 22",
        "Mar 16 10:30:45 h su: session opened for user x",
        "Mar 16 10:30:45 h sudo: x : session opened root",
        "Mar 16 10:30:45 h sudo:: USER=root FROM 9.9.9.9",
        "authentication failure from",
        "Accepted password from ",
        "a b c d svc:: ACCEPTED PASSWORD from x",
        "plain\tline",
        "",
    ]
    df = spark.createDataFrame([("/var/log/x", line) for line in lines], "path string, line string")
    out = {r.raw_message: r for r in parse_log_lines(df, agent_id="a1").collect()}
    assert len(out) == 8 and len({r.event_id for r in out.values()}) == 8
    got = [(out[x].type.removeprefix("EVENT_TYPE_"), out[x].service, out[x].source_ip) for x in lines[:8]]
    assert got == [
        ("AUTH_FAILURE", "sshd", "1.2.3.4"),
        ("AUTH_SUCCESS", "su", ""),
        ("AUTH_SUCCESS", "sudo", ""),
        ("PRIVILEGE_ESCALATION", "sudo", "9.9.9.9"),
        ("AUTH_FAILURE", "", ""),
        ("AUTH_SUCCESS", "", ""),
        ("AUTH_SUCCESS", "svc:", "x"),
        ("SYSTEM_CALL", "", ""),
    ]
    assert out[lines[0]].metadata == {"source_file": "/var/log/x"}


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\ntwo\n")
    assert sorted(r.line for r in read_log_lines(spark, str(tmp_path)).collect()) == ["one", "two"]


def test_process_diff(spark):
    rows = [("h", 1, 1, "init\0"), ("h", 1, 2, "a\0b\0"), ("h", 2, 1, "other"), ("h", 2, 3, " \0"), ("h", 3, 1, "x"), ("g", 2, 9, "only")]
    df = spark.createDataFrame(rows, "host string, s bigint, pid int, cmdline string").withColumn("snapshot_ts", F.timestamp_seconds("s"))
    got = sorted((r.type[11:], r.hostname, r.metadata["pid"], r.process, r.timestamp.timestamp()) for r in process_diff(df).collect())
    assert got == [
        ("PROCESS_START", "h", "3", "[pid:3]", 2.0),
        ("PROCESS_STOP", "h", "2", "a b", 2.0),
        ("PROCESS_STOP", "h", "3", "[pid:3]", 3.0),
    ]


def test_batches(spark):
    rows = [("a", i * 1000, f"e{i:03d}") for i in range(250)] + [("a", 6_000_000, "z"), ("b", 3, "b")]
    df = spark.createDataFrame(rows, "agent_id string, us bigint, event_id string")
    sizes = assign_batches(df, "us", "event_id").groupBy("agent_id", "sequence").count().collect()
    assert sorted(map(tuple, sizes)) == [("a", 1, 100), ("a", 2, 100), ("a", 3, 50), ("a", 4, 1), ("b", 1, 1)]


def test_ingest(spark):
    s = 1_000_000
    rows = [("a", 0), ("a", 299 * s), ("a", 300 * s), ("a", 500 * s), ("a", 601 * s), ("", 1), ("b", 5)]
    df = spark.createDataFrame(rows, "event_id string, arrival_us bigint").withColumn("agent_id", F.lit("x")).withColumn("sequence", F.lit(1))
    for ttl in ("300s", "0s"):
        out = ingest(df, ttl)
        assert sorted(r.arrival_us for r in out.accepted.filter("event_id = 'a'").collect()) == [0, 300 * s, 601 * s]
        total = out.summary.head()
        assert (total.accepted, total.rejected) == (4, 3)
        assert [tuple(r) for r in total.rejected_events] == [("", "empty event_id"), ("a", "duplicate"), ("a", "duplicate")]
    assert ingest(df, dedup=False).accepted.count() == 6
    assert ingest(df.limit(0)).summary.count() == 0


IPS = [
    "10.0.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.1", "192.168.1.100", "8.8.8.8", "127.0.0.1", "256.1.1.1", "010.0.0.1", "1.2.3", "1.2.3.4.5", " 10.0.0.1",
    "::1", "::", "0:0:0:0:0:0:0:1", "fc00::1", "fdff:1::", "fe80::1", "fc::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::FFFF:C0A8:1", "0:0:0:0:0:ffff:7f00:1", "::ffff:ac1f:1",
    "::ffff:a00:1", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "1::2::3", "2001:db8::1", "12345::", "::1.2.3.4", "fe80::1%eth0", ":1", "1:", "::0.0.0.1", "abc", "FD00::1", "0::ffff:0:10.0.0.1",
]


def go_local(text):
    """What the address classes say, by Python's parser, which agrees on validity but for zones."""
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    if "%" in text:
        return None
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    nets = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8"] if ip.version == 4 else ["fc00::/7", "::1/128"]
    return any(ip in ipaddress.ip_network(n) for n in nets)


def test_addresses(spark):
    rng = random.Random(5)
    made = [str(ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 0, 64, 96, 120]))) for _ in range(80)]
    made += [ipaddress.IPv6Address(rng.getrandbits(128)).exploded for _ in range(20)]
    texts = IPS + made
    df = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", is_private_or_loopback(F.col("ip")).alias("local"))
    got = {r.ip: r.local for r in df.collect()}
    assert {t: got[t] for t in texts if got[t] != go_local(t)} == {}


def event(spark, ip, kind="EVENT_TYPE_AUTH_FAILURE", metadata=None):
    df = spark.createDataFrame([(ip, kind, metadata)], "source_ip string, type string, metadata map<string,string>")
    return normalise_events(df)


def test_enrichment(spark):
    threats = default_threats(spark)
    both = [geo_enrich, lambda df: threat_enrich(df, threats)]
    meta = lambda ip, **m: enrich(event(spark, ip, metadata=m or None), both).head().metadata
    assert meta("192.168.1.100") == {"geo_is_private": "true", "geo_country": "PRIVATE", "threat_known": "false"}
    assert meta("185.220.101.34") == {"geo_is_private": "false", "geo_country": "UNKNOWN", "threat_known": "true", "threat_category": "tor_exit"}
    assert meta("") == {}
    assert meta("not-an-ip", threat_category="mine", threat_known="?") == {"threat_known": "false", "threat_category": "mine"}
    assert meta("71.6.135.131", threat_category="mine")["threat_category"] == "scanner"
    assert len(DEFAULT_THREATS) == 6
    failing = guarded("broken", {"x": F.lit("1")}, F.lit("boom"))
    row = enrich(event(spark, "185.220.101.34"), [failing, *both]).head()
    assert row.enrich_errors == ["broken: boom"] and row.metadata["threat_known"] == "true" and "x" not in row.metadata


def test_upsert(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "o map<string,string>, n map<string,string>")
    assert df.select(upsert(F.col("o"), F.col("n")).alias("m")).head().m == {"a": "1", "b": "3", "c": "4"}


@pytest.mark.parametrize(
    "kind,threat,want",
    [
        ("PRIVILEGE_ESCALATION", "true", "CRITICAL"), ("PRIVILEGE_ESCALATION", None, "HIGH"), ("AUTH_FAILURE", "true", "HIGH"), ("AUTH_FAILURE", "false", "MEDIUM"),
        ("FILE_MODIFY", None, "MEDIUM"), ("AUTH_SUCCESS", "true", "LOW"), ("PROCESS_START", None, "LOW"), ("UNSPECIFIED", None, "LOW"),
    ],
)
def test_severity(spark, kind, threat, want):
    df = event(spark, "1.1.1.1", f"EVENT_TYPE_{kind}", {"threat_known": threat} if threat else None)
    assert classify_severity(df).head().severity == f"SEVERITY_{want}"


def alert_frame(spark, rows):
    """rows: (alert_id, rule_id, group, seconds or None, tags, enrichment, name)"""
    df = spark.createDataFrame(rows, "alert_id string, rule_id string, g string, s double, tags array<string>, enrichment map<string,string>, rule_name string")
    return df.select(
        "alert_id", "rule_id", "rule_name", F.lit("SEVERITY_HIGH").alias("severity"), F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("created_at"),
        F.lit("d").alias("description"), F.create_map(F.lit("group_key"), "g").alias("group_values"), F.lit(3).cast("bigint").alias("event_count"),
        F.array("alert_id").alias("event_ids"), "tags", "enrichment",
    )


def simple_alerts(spark, *rows):
    return alert_frame(spark, [(i, r, g, float(s), [], {}, "n") for i, r, g, s in rows])


def test_suppression_boundary(spark):
    df = simple_alerts(spark, ("a", "r", "g", 0), ("b", "r", "g", 300), ("c", "r", "g", 300.000001), ("d", "r", "h", 1), ("e", "q", "g", 1))
    kept = {r.alert_id for r in A.suppress(df, "300s").filter("kept").collect()}
    assert kept == {"a", "c", "d", "e"}


def test_rate_limited_alert_still_silences(spark):
    df = simple_alerts(spark, ("a", "r", "1", 0), ("b", "r", "2", 0), ("c", "r", "3", 0), ("d", "r", "3", 10), ("e", "r", "4", 10))
    got = {r.alert_id: r.decision for r in A.decide(df, "300s", rate=1.0).collect()}
    assert got == {"a": "sent", "b": "sent", "c": "rate_limited", "d": "suppressed", "e": "sent"}
    assert A.refill_micros(100.0) == 10_000 and A.refill_micros(5000.0) == 1000


def test_token_bucket_matches_a_plain_loop(spark):
    rng = random.Random(3)
    for interval, capacity, chunk in [(5, 3, 4), (50, 1, 8), (2, 10, 512)]:
        rows = [(f"k{rng.randrange(3)}", rng.choice([rng.randrange(300), rng.randrange(2000)]), f"e{i:04d}") for i in range(400)]
        df = spark.createDataFrame(rows, "k string, ts bigint, id string")
        out = A.token_bucket(df, "ts", "id", interval, capacity, ["k"], ticks_per_chunk=chunk)
        assert out.count() == 400
        assert sorted(r.id for r in out.filter("allowed").collect()) == brute.token_bucket(rows, interval, capacity)
        everyone = A.token_bucket(df, "ts", "id", interval, capacity, ticks_per_chunk=chunk)
        assert sorted(r.id for r in everyone.filter("allowed").collect()) == brute.token_bucket([("all", t, i) for _, t, i in rows], interval, capacity)


def test_payload_bytes(spark):
    odd = "<a> & \"b\" \\u001B \x1b\x0b\x08\x0c\n   é/"
    df = alert_frame(spark, [("i", "r", odd, None, [], {}, odd), ("j", "r", "g", 1.5, ["x", "<"], {"b": "2", "a": "1"}, "n")])
    out = {r.alert_id: r.payload for r in A.notification_payload(df).collect()}
    first, second = out["i"], out["j"]
    assert json.loads(first)["rule_name"] == odd and json.loads(first)["created_at"] == "1970-01-01T00:00:00Z"
    assert '"tags":null' in first and '"enrichment":null' in first
    for raw in "<>&  ":
        assert raw not in first
    assert "\\\\u001B \\u001b\\u000b\\b\\f\\n\\u2028" in first
    assert second == (
        '{"alert_id":"j","created_at":"1970-01-01T00:00:01Z","description":"d","enrichment":{"a":"1","b":"2"},"event_count":3,'
        '"group":{"group_key":"g"},"rule_id":"r","rule_name":"n","severity":"SEVERITY_HIGH","tags":["x","\\u003c"]}'
    )


@pytest.mark.parametrize("secret", ["k", "x" * 64, "é" * 70])
def test_hmac(spark, secret):
    body = "message é"
    df = spark.createDataFrame([(body,)], "b string").select(hmac_sha256(F.col("b"), secret).alias("h"))
    assert df.head().h == hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def test_delivery(spark):
    alerts = A.notification_payload(simple_alerts(spark, ("a", "r", "g", 0), ("b", "r", "g", 1)))
    channels = [delivery.LOG_CHANNEL, delivery.Channel("hook", "http://x", "s"), delivery.Channel("off", "")]
    work = delivery.delivery_tasks(alerts, channels)
    assert work.count() == 6
    headers = {r.channel: r.headers for r in work.filter("alert_id = 'a'").collect()}
    assert headers["hook"]["X-Alert-Signature"].startswith("sha256=") and "X-Alert-Signature" not in headers["off"]

    def send(channel, url, headers, body):
        if channel == "hook" and '"alert_id":"a"' in body:
            return 503
        if channel == "off":
            raise AssertionError("must not be called")
        return 299

    done, letters = delivery.deliver(work, send, pause=lambda _: None)
    got = {(r.alert_id, r.channel): (r.status, r.attempts) for r in done.collect()}
    assert got[("a", "hook")] == ("dlq", 3) and got[("b", "hook")] == ("sent", 1) and got[("a", "off")] == ("sent", 0)
    letter = letters.collect()
    assert len(letter) == 1 and letters.schema.names == DEAD_LETTER_SCHEMA.names
    assert letter[0].error == "channel hook: max retry attempts reached: webhook returned status 503"
    assert letter[0].original_topic == "alerts.dispatch" and json.loads(letter[0].value.decode())["alert_id"] == "a"


def test_retry_delays():
    assert delivery.retry_delays() == [500, 1000]
    assert delivery.retry_delays(4, 10, 2.0, 15) == [10, 15, 15]
    assert delivery.retry_delays(3, 20, 2.0, 15) == [20, 15]


def test_dead_letters_keep_newest_and_drain(spark):
    df = spark.createDataFrame([(n, i) for i, n in enumerate("ABCD")], "name string, failed_at int")
    assert sorted(r.name for r in delivery.keep_newest(df, 3).collect()) == ["B", "C", "D"]
    assert sorted(r.name for r in delivery.drain(df, df.filter("name = 'A'"), ["name"]).collect()) == ["B", "C", "D"]


def test_payload_defaults(spark):
    df = spark.createDataFrame([("{}",), ("nonsense",)], "payload string")
    assert {(r.alert_id, r.severity) for r in delivery.log_lines(df).collect()} == {("", "UNKNOWN")}


def test_insert_if_absent(spark, tmp_path):
    path = str(tmp_path / "events")
    shape = "event_id string, type string, timestamp timestamp, hostname string, source_ip string"
    at = lambda s: datetime.fromtimestamp(s, timezone.utc)
    first = normalise_events(spark.createDataFrame([("a", "T", at(5), "h", "1"), ("a", "T", at(2), "h", "2")], shape))
    persist.insert_if_absent(persist.event_rows(first), path)
    again = normalise_events(spark.createDataFrame([("a", "T", at(1), "h", "3"), ("b", "T", at(90_000), "h", "4")], shape))
    persist.insert_if_absent(persist.event_rows(again), path)
    table = spark.read.parquet(path)
    assert sorted((r.event_id, r.source_ip) for r in table.collect()) == [("a", "2"), ("b", "4")]
    plan = persist.in_time_range(table, at(90_000), at(90_001))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_protobuf_round_trip(spark):
    df = normalise_events(
        spark.createDataFrame([("e", "EVENT_TYPE_AUTH_FAILURE", 1.000001, 22, {"k": "v"})], "event_id string, type string, s double, source_port bigint, metadata map<string,string>")
        .withColumn("timestamp", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint"))).drop("s")
    )
    good = decode(encode_protobuf(df).select("value"), encoding="protobuf").good
    assert good.collect() == df.select(*good.columns).collect()
    # field 2 (type) = 42 lies outside the enum and prints as a number
    raw = spark.createDataFrame([(bytearray(b"\x0a\x01x\x10\x2a"),), (bytearray(b"\x0a\x7f"),)], "value binary")
    out = decode(raw, encoding="protobuf")
    row = out.good.head()
    assert (row.event_id, row.type, row.timestamp, row.severity) == ("x", "42", None, "SEVERITY_UNSPECIFIED")
    assert out.malformed.count() == 1
    alert = simple_alerts(spark, ("a", "r", "g", 1))
    back = decode(encode_protobuf(alert.select(*ALERT_SCHEMA.names), "Alert").select("value"), message="Alert", encoding="protobuf").good
    assert back.collect() == alert.select(*ALERT_SCHEMA.names).collect()


def test_topics(spark, tmp_path):
    options = topics.kafka_options(["a:1", "b:2"], "raw-events", 5)
    assert options["startingOffsets"] == "earliest" and options["kafka.bootstrap.servers"] == "a:1,b:2"
    span = topics.replay_options(["a:1"], "t", parse_rfc3339("2024-01-01T00:00:00Z"), parse_rfc3339("2024-01-01T00:00:01Z"))
    assert int(span["endingTimestamp"]) - int(span["startingTimestamp"]) == 1001
    write_alerts(simple_alerts(spark, ("a", "r1", "g", 1), ("b", "r2", "g", 1)), str(tmp_path / "alerts"))
    assert sorted(p.name for p in (tmp_path / "alerts").glob("rule_id=*")) == ["rule_id=r1", "rule_id=r2"]


def test_replay_arguments(spark):
    df = event(spark, "1.1.1.1")
    for start, end in [("", "2024-01-01T00:00:00Z"), ("2024-01-01", "2024-01-02"), ("x", "y")]:
        with pytest.raises(ValueError):
            replay(df, start, end, [])


def test_times(spark):
    at = parse_rfc3339("2024-02-29T23:59:59.5+02:00")
    row = spark.range(1).select(rfc3339(instant(at)).alias("t")).head()
    assert row.t == "2024-02-29T21:59:59Z"


def test_counter_rate_with_reset_and_slabs(spark):
    rows = [("s", i * 10_000_000, float(v)) for i, v in enumerate([0, 5, 9, 2, 4] * 300)]
    df = spark.createDataFrame(rows, "k string, ts_us bigint, value double")
    got = {r.ts_us: r.rate for r in metrics.counter_rate(df, ["k"], window="30s").collect()}
    assert len(got) == 1500
    step = [0.0] + [b - a if b >= a else b for (_, _, a), (_, _, b) in zip(rows, rows[1:])]
    want = {t: sum(step[max(i - 1, 1) : i + 1]) / 30 for i, (_, t, _) in enumerate(rows)}
    assert got == pytest.approx(want)


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", 0.001), ("a", 0.2), ("a", 99.0)], "k string, v double")
    buckets = metrics.bucketize(df, ["k"], "v")
    counts = [r["count"] for r in buckets.orderBy("le").collect()]
    assert counts == [1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3]
    assert metrics.histogram_quantile(buckets, ["k"], 0.99).head()["quantile"] == 5.0
    assert metrics.histogram_quantile(buckets, ["k"], 0.5).head()["quantile"] == pytest.approx(0.1 + 0.15 * 0.5)
    empty = buckets.withColumn("count", F.lit(0))
    assert metrics.histogram_quantile(empty, ["k"], 0.5).head()["quantile"] is None
