"""Headline queries on one machine: prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the tables and the cores. Each query runs once to warm up the JVM
and the Python workers and is then timed over ``BENCH_RUNS`` runs; the fastest counts.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import functions as F

from checks.fixture import DAY, security_events, threats
from checks.queries import QUERIES, example_rules
from ravelin.operators.evaluate import evaluate
from ravelin.operators.rules import Condition, Rule
from ravelin.plans.pipeline import run_pipeline
from ravelin.session import local_session
from ravelin.streaming.jobs import stream_evaluate

HEADLINE = [
    "single_rule",
    "threshold_3_in_3_days",
    "sequence_3_days",
    "rules_in_one_pass",
    "hot_group_rules",
    "bursty_group_rules",
    "alerts",
    "event_severity",
    "geo_enrichment",
    "log_line_classes",
    "ingest_decisions",
    "suppression",
    "token_bucket_global",
    "notification_payload",
    "delivery_tasks",
    "replay_totals",
    "counter_rate",
    "latency_quantiles",
]


def timed(spark, name: str, sf_dir: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def many_rules(spark, sf_dir: str, count: int) -> float:
    """Single and threshold rules on one host and service each, evaluated in one pass."""
    rules = []
    for i in range(count):
        tests = (Condition("type", "eq", "EVENT_TYPE_AUTH_FAILURE"), Condition("user", "eq", f"user-{i}"))
        kind = {"type": "single"} if i % 2 else {"type": "threshold", "threshold": 3, "window_micros": 3 * DAY}
        rules.append(Rule(f"r{i}", f"r{i}", conditions=tests, group_by=("source_ip",), **kind))
    events = security_events(spark, sf_dir)
    begun = time.perf_counter()
    evaluate(events, rules, dedup=True).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def micro_batch(spark, sf_dir: str, folder: str) -> float:
    """Median seconds of a micro-batch of the rule stream, over eight files in time order."""
    path = f"{folder}/stream"
    security_events(spark, sf_dir).repartitionByRange(8, "timestamp").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (
        stream_evaluate(stream, example_rules(spark), "1 hour")
        .writeStream.format("noop").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination(600)
    times = [p["durationMs"]["triggerExecution"] for p in query.recentProgress if p["numInputRows"]]
    return statistics.median(times) / 1000


def alerts_at(spark, sf_dir: str, copies: int, folder: str) -> float:
    """The alert path over a stored canonical table: the events and copies of them, each thirty-one days
    later than the one before."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    (
        security_events(spark, sf_dir)
        .withColumn("copy", copy)
        .withColumn("event_id", F.concat("event_id", F.lit("-"), "copy"))
        .withColumn("timestamp", F.timestamp_micros(F.unix_micros("timestamp") + F.col("copy") * (31 * DAY)))
        .repartition(16)
        .drop("copy")
        .write.mode("overwrite")
        .parquet(f"{folder}/events")
    )
    stored = spark.read.parquet(f"{folder}/events")
    times = []
    for _ in range(2):
        begun = time.perf_counter()
        out = run_pipeline(stored, example_rules(spark), threats(spark, sf_dir))
        out.alerts.write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - begun)
    return min(times)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        timed(spark, name, sf_dir)
        times[name] = round(min(timed(spark, name, sf_dir) for _ in range(runs)), 3)
    events = security_events(spark, sf_dir).count()
    with tempfile.TemporaryDirectory(prefix="ravelin-bench-") as folder:  # one machine
        scaled = round(alerts_at(spark, sf_dir, 10, folder), 3)
        batch = round(micro_batch(spark, sf_dir, folder), 3)
    rules_500 = round(min(many_rules(spark, sf_dir, 500) for _ in range(2)), 3)
    rules_2000 = round(min(many_rules(spark, sf_dir, 2_000) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "seconds for the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": events,
                "events_per_second_alert_path": round(events / times["alerts"]),
                "alerts_tenfold_seconds": scaled,
                "rules_500_seconds": rules_500,
                "rules_2000_seconds": rules_2000,
                "micro_batch_seconds": batch,
                "events_per_second_tenfold": round(10 * events / scaled),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
