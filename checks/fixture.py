"""Security events derived from the ``events`` table, once for Spark and once as SQL text.

Each user is one source address in one of five classes (three private ranges, public, public and listed).
Events of one user lie hours apart, so windows are in days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.times import ntz_micros
from ravelin.schema import normalise_events

DAY = 86_400_000_000

_KIND = """CASE event_type WHEN 'error' THEN 'EVENT_TYPE_AUTH_FAILURE' WHEN 'signup' THEN 'EVENT_TYPE_AUTH_SUCCESS'
 WHEN 'purchase' THEN 'EVENT_TYPE_PRIVILEGE_ESCALATION' WHEN 'view' THEN 'EVENT_TYPE_FILE_MODIFY'
 ELSE 'EVENT_TYPE_PROCESS_START' END"""


def _ip(div: str) -> str:
    byte = lambda n: f"CAST(({div.format(n)}) % 256 AS VARCHAR(3))"
    low = f"{byte(256)} || '.' || CAST(user_id % 256 AS VARCHAR(3))"
    return f"""CASE user_id % 5
 WHEN 0 THEN '10.' || {byte(65536)} || '.' || {low}
 WHEN 1 THEN '172.' || CAST(16 + ({div.format(65536)}) % 16 AS VARCHAR(3)) || '.' || {low}
 WHEN 2 THEN '192.168.' || {low}
 WHEN 3 THEN '8.' || {byte(65536)} || '.' || {low}
 ELSE '185.' || {byte(65536)} || '.' || {low} END"""


def _message() -> str:
    head = "'Jan 01 00:00:00 ' || hostname || ' '"
    return f"""CASE
 WHEN event_type = 'error' AND k % 3 = 0 THEN {head} || service || '[' || CAST(k AS VARCHAR(9)) || ']: Failed password for ' || user_name || ' from ' || source_ip || ' port ' || CAST(k AS VARCHAR(9))
 WHEN event_type = 'error' THEN {head} || service || ':: Authentication Failure;   user=' || user_name || ' FROM ' || source_ip
 WHEN event_type = 'signup' THEN {head} || service || ': Accepted password for ' || user_name || ' from ' || source_ip || ' ssh2'
 WHEN event_type = 'purchase' AND k % 4 = 0 THEN {head} || 'sudo: session opened for user root from ' || source_ip
 WHEN event_type = 'purchase' THEN {head} || 'sudo: ' || user_name || ' : COMMAND=/bin/sh USER=root'
 WHEN event_type = 'view' THEN 'restarted from ' || source_ip
 WHEN k % 10 = 0 THEN ''
 ELSE {head} || 'kernel: link up' END"""


def spark_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table with the derived plain columns and ``ts_us``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    div = "user_id div {0}"
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .withColumn("ts_us", ntz_micros("ts"))
        .withColumn("k", F.regexp_extract("props", r"([0-9]+)", 1).cast("int"))
        .withColumn("type", F.expr(_KIND.replace("VARCHAR", "STRING")))
        .withColumn("source_ip", F.expr(_strings(_ip(div))))
        .withColumn("hostname", F.concat(F.lit("host-"), F.col("user_id") % 7))
        .withColumn("service", F.when(F.col("k") % 2 == 0, "sshd").otherwise("nginx"))
        .withColumn("user_name", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
        .withColumn("agent_id", F.concat(F.lit("agent-"), F.col("user_id") % 3))
        .withColumn("raw_message", F.expr(_strings(_message())))
        .withColumn("event_id", F.col("event_id").cast("string"))
    )


def _strings(sql: str) -> str:
    return sql.replace("VARCHAR(9)", "STRING").replace("VARCHAR(3)", "STRING")


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events of the whole table."""
    raw = spark_events(spark, sf_dir)
    return normalise_events(
        raw.select(
            "event_id",
            "type",
            F.timestamp_micros("ts_us").alias("timestamp"),
            "hostname",
            "source_ip",
            F.col("k").cast("bigint").alias("source_port"),
            F.col("user_name").alias("user"),
            "service",
            "raw_message",
            F.create_map(F.lit("k"), F.col("k").cast("string")).alias("metadata"),
            "agent_id",
        )
    )


def threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed addresses: every user of the fifth class."""
    raw = spark_events(spark, sf_dir)
    category = F.when(F.floor(F.col("user_id") / 5) % 2 == 0, "tor_exit").otherwise("scanner")
    return raw.filter("user_id % 5 = 4").select("source_ip", category.alias("category")).distinct()


# The same as common table expressions. ``ev`` has one row per event.
EVENTS_SQL = f"""raw0 AS (
 SELECT *, epoch_us(ts) AS ts_us, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events
), raw1 AS (
 SELECT *, {_KIND} AS type, {_ip("user_id // {0}")} AS source_ip, 'host-' || (user_id % 7) AS hostname,
 CASE WHEN k % 2 = 0 THEN 'sshd' ELSE 'nginx' END AS service, 'user-' || user_id AS user_name,
 'agent-' || (user_id % 3) AS agent_id FROM raw0
), ev0 AS (
 SELECT * REPLACE (CAST(event_id AS VARCHAR) AS event_id), {_message()} AS raw_message FROM raw1
), ev AS (
 SELECT *, CASE WHEN user_id % 5 = 4 THEN CASE WHEN (user_id // 5) % 2 = 0 THEN 'tor_exit' ELSE 'scanner' END END AS threat_hit,
 user_id % 5 IN (0, 1, 2) AS is_private FROM ev0
)"""

SEVERITY_SQL = """CASE WHEN type = 'EVENT_TYPE_PRIVILEGE_ESCALATION' THEN CASE WHEN threat_hit IS NOT NULL THEN 'SEVERITY_CRITICAL' ELSE 'SEVERITY_HIGH' END
 WHEN type = 'EVENT_TYPE_AUTH_FAILURE' THEN CASE WHEN threat_hit IS NOT NULL THEN 'SEVERITY_HIGH' ELSE 'SEVERITY_MEDIUM' END
 WHEN type = 'EVENT_TYPE_FILE_MODIFY' THEN 'SEVERITY_MEDIUM' ELSE 'SEVERITY_LOW' END"""
