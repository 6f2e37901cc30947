"""Process start and stop events from snapshots ``(host, snapshot_ts, pid, cmdline)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.schema import normalise_events


def process_name(cmdline: Column, pid: Column) -> Column:
    """NUL separators become blanks; an empty command line reads ``[pid:N]``."""
    text = F.trim(F.regexp_replace(F.coalesce(cmdline, F.lit("")), r"\x00", " "), F.lit(" \t\n\r\f\x0b"))
    return F.when(text == "", F.format_string("[pid:%d]", pid)).otherwise(text)


def process_diff(snapshots: DataFrame, agent_id: str = "") -> DataFrame:
    """A pid that appears is a start, one that disappears is a stop with its last command. The first
    snapshot of a host emits nothing, and a pid that is reused between snapshots is not seen.

    Snapshots are numbered on the distinct ``(host, snapshot_ts)`` pairs, and the comparisons are
    anti joins on ``(host, pid, number)``, so a busy host spreads over its pids and snapshots.
    """
    named = snapshots.select("host", "snapshot_ts", "pid", process_name(F.col("cmdline"), F.col("pid")).alias("process"))
    per_host = Window.partitionBy("host").orderBy("snapshot_ts")
    numbers = (
        named.select("host", "snapshot_ts").distinct()
        .withColumn("number", F.row_number().over(per_host))
        .withColumn("next_ts", F.lead("snapshot_ts").over(per_host))
    )
    rows = named.join(numbers, ["host", "snapshot_ts"])
    key = ["host", "pid", "number"]
    before = rows.select("host", "pid", (F.col("number") + 1).alias("number"))
    after = rows.select("host", "pid", (F.col("number") - 1).alias("number"))
    started = rows.filter(F.col("number") > 1).join(before, key, "left_anti")
    stopped = rows.filter(F.col("next_ts").isNotNull()).join(after, key, "left_anti")
    shape = lambda df, kind, ts: df.select(
        F.lit(kind).alias("type"), F.col(ts).alias("timestamp"), "host", "pid", "process"
    )
    changes = shape(started, "EVENT_TYPE_PROCESS_START", "snapshot_ts").unionByName(
        shape(stopped, "EVENT_TYPE_PROCESS_STOP", "next_ts")
    )
    return change_events(changes, agent_id)


def change_events(changes: DataFrame, agent_id: str = "") -> DataFrame:
    """``(type, timestamp, host, pid, process)`` as events; the id is a hash, so a rerun gives the same."""
    return normalise_events(
        changes.select(
            F.sha2(
                F.concat_ws("\u0001", "type", "host", F.col("pid").cast("string"), F.unix_micros("timestamp").cast("string")),
                256,
            ).alias("event_id"),
            "type",
            "timestamp",
            F.col("host").alias("hostname"),
            "process",
            F.create_map(F.lit("pid"), F.col("pid").cast("string")).alias("metadata"),
            F.lit(agent_id).alias("agent_id"),
        )
    )
