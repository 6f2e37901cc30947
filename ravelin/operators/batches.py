"""Batches of events per agent: a flush at a number of events or at each tick."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.durations import duration_micros
from ravelin.functions.names import hidden


def assign_batches(
    df: DataFrame, ts: str, tie: str, size: int = 100, interval: str = "5s", origin: str | None = None
) -> DataFrame:
    """Adds ``sequence``, counting from 1 per agent. Ticks fall on multiples of ``interval`` from
    ``origin`` (a bigint column; the agent's first row when absent) and are not moved by a full batch.

    Rows are numbered inside ``(agent, tick)`` only; the sequence number comes from batch counts per tick. Other
    columns may have any names.
    """
    df, name, back = hidden(df, {"tick", "chunk", "first_us", "batches", "before"})
    ts, tie, origin = name(ts), name(tie), origin and name(origin)
    size = size if size > 0 else 100
    step = duration_micros(interval)
    step = step if step > 0 else duration_micros("5s")
    based = df
    if origin is None:
        origins = df.groupBy("agent_id").agg(F.min(ts).alias("first_us"))
        based, origin = df.join(origins, "agent_id"), "first_us"
    ticked = based.withColumn("tick", F.floor((F.col(ts) - F.col(origin)) / F.lit(step)).cast("bigint"))
    in_tick = Window.partitionBy("agent_id", "tick").orderBy(ts, tie)
    chunked = ticked.withColumn("chunk", F.floor((F.row_number().over(in_tick) - 1) / F.lit(size)).cast("bigint"))
    per_tick = ticked.groupBy("agent_id", "tick").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("batches"))
    earlier = Window.partitionBy("agent_id").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_tick.select(
        "agent_id", "tick", F.coalesce(F.sum("batches").over(earlier), F.lit(0)).alias("before")
    )
    joined = chunked.join(starts, ["agent_id", "tick"])
    return back(joined.withColumn("sequence", (F.col("before") + F.col("chunk") + 1).cast("bigint")), "sequence")


def event_batches(assigned: DataFrame, ts: str, tie: str) -> DataFrame:
    """One row per batch with its events as an array, which ``size`` bounds."""
    columns = [c for c in assigned.columns if c not in ("agent_id", "sequence")]
    others = [c for c in columns if c not in (ts, tie)]
    return assigned.groupBy("agent_id", "sequence").agg(
        F.array_sort(
            F.collect_list(F.struct(ts, tie, *others)), lambda a, b: F.when(F.struct(a[ts], a[tie]) < F.struct(b[ts], b[tie]), -1).otherwise(1)
        ).alias("events")
    )
