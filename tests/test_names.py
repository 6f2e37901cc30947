"""A caller's columns of an operator's own names come out as they were; null ids, keys and repeated rows count."""

import pytest
from pyspark.sql import functions as F

from ravelin.operators import alerts, batches, metrics, ordered
from ravelin.operators.evaluate import evaluate
from ravelin.operators.ingest import reject_reason
from ravelin.operators.rules import Condition, Rule
from ravelin.schema import normalise_events
from tests import brute

ROWS = [(f"k{i % 3}", i * 700_000 % 9_000_000, f"r{i:02d}") for i in range(40)]
OPERATORS = {
    "first_per_window": (lambda df: ordered.first_per_window(df, ["agent_id"], "ts", ["id"], 900_000, True), ordered.RESERVED),
    "first_per_window_hot": (lambda df: ordered.first_per_window(df, ["agent_id"], "ts", ["id"], 900_000, True, "kept", 8, 4), ordered.RESERVED),
    "token_bucket": (lambda df: alerts.token_bucket(df, "ts", "id", 1_000_000, 2), alerts.BUCKET_RESERVED),
    "token_bucket_keys": (lambda df: alerts.token_bucket(df, "ts", "id", 1_000_000, 2, ["agent_id"]), alerts.BUCKET_RESERVED),
    "assign_batches": (lambda df: batches.assign_batches(df, "ts", "id", 3, "2s"), {"tick", "chunk", "first_us", "batches", "before"}),
    "counter_rate": (lambda df: metrics.counter_rate(df, ["agent_id"], "ts", "v"), {"home", "slab", "step"}),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_of_any_name(spark, name):
    run, reserved = OPERATORS[name]
    plain = spark.createDataFrame([(*r, float(n)) for n, r in enumerate(ROWS)], "agent_id string, ts bigint, id string, v double")
    odd = plain.select("*", *[F.concat(F.lit(f"{c}-"), "id").alias(c) for c in sorted(reserved)], F.lit("z").alias("Place_2"))
    want, got = run(plain), run(odd)
    assert got.columns[: len(odd.columns)] == odd.columns
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    for c in sorted(reserved):
        assert got.filter(F.col(c) != F.concat(F.lit(f"{c}-"), "id")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeated_rows_take_a_token_each(spark, seed):
    rows = [("k", 1_000_000 * (i // 7), f"r{(i * seed) % 4}") for i in range(60)] + [("k", 5, "x")] * 5
    df = spark.createDataFrame(rows, "k string, ts bigint, id string")
    got = alerts.token_bucket(df, "ts", "id", 1_000_000, 2, ["k"]).filter("allowed").collect()
    assert sorted(r["id"] for r in got) == brute.token_bucket(rows, 1_000_000, 2)


def test_null_keys_and_times_have_a_bucket(spark):
    df = spark.createDataFrame([(None, None, "a"), (None, 5, "b"), ("", 5, "c"), ("", 6, "d")], "k string, ts bigint, id string")
    out = alerts.token_bucket(df, "ts", "id", 1_000_000, 1, ["k"])
    assert sorted((r["id"], r["allowed"]) for r in out.collect()) == [("a", True), ("b", False), ("c", True), ("d", False)]


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_parts_in_time_order_equal_the_whole(spark, keys):
    rows = [(f"k{i % 3}", (i * i * 37_000) % 40_000_000, f"r{i:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts bigint, id string")
    whole = sorted(r["id"] for r in alerts.token_bucket(df, "ts", "id", 500_000, 3, keys, "allowed", 8).filter("allowed").collect())
    state, parts = None, []
    for low in range(0, 40_000_000, 7_300_000):
        part = df.filter(F.col("ts").between(low, low + 7_299_999))
        out, after = alerts.token_bucket_from(part, state, "ts", "id", 500_000, 3, keys, "allowed", 8)
        parts += [r["id"] for r in out.filter("allowed").collect()]
        state = spark.createDataFrame(after.collect(), alerts.BUCKET_STATE)
    # ticks count from the key's first row, so parts agree with the whole as they carry that instant on
    assert sorted(parts) == whole == brute.token_bucket([("one" if not keys else k, t, i) for k, t, i in rows], 500_000, 3)


def test_null_ids_are_empty_ids(spark):
    rows = [(None if i % 2 else "", "h", (i // 4) * 1_000_000) for i in range(40)] + [("x", "h", 5)] * 3
    raw = spark.createDataFrame(rows, "event_id string, hostname string, us bigint")
    events = normalise_events(raw.select("event_id", "hostname", F.timestamp_micros("us").alias("timestamp"), F.lit("A").alias("type"))).withColumn("event_id", F.when(F.col("event_id") != "", F.col("event_id")))
    rule = Rule("t", "t", "threshold", conditions=(Condition("type", "eq", "A"),), group_by=("hostname",), threshold=2, window_micros=10**9)
    for dedup in (False, True):
        counts = {n: evaluate(events, [rule], hot_rows=n, chunk_rows=4, dedup=dedup).count() for n in (None, 10)}
        assert counts == {None: 21 if not dedup else 20, 10: 21 if not dedup else 20}
    frame = raw.select("event_id", F.col("us").alias("arrival_us"), F.lit("mine").alias("kept"))
    judged = reject_reason(frame)
    assert judged.count() == 43 and judged.filter("reason = 'empty event_id'").count() == 40 and judged.filter("kept = 'mine'").count() == 43
    assert reject_reason(frame, dedup=False).filter("reason IS NOT NULL").count() == 40
