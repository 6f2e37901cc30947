"""Ingest: validation, de-duplication with a time to live, accounting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions.durations import duration_micros
from ravelin.functions.names import free
from ravelin.operators.enrich import lookup_side
from ravelin.operators.ordered import HOT_ROWS, first_per_window

EMPTY_ID, DUPLICATE = "empty event_id", "duplicate"
DEFAULT_TTL = "300s"
LISTED = 1_000  # rejected events of one list


@dataclass(frozen=True)
class Ingested:
    accepted: DataFrame
    rejected: DataFrame
    summary: DataFrame


def reject_reason(
    df: DataFrame,
    ttl: str = DEFAULT_TTL,
    dedup: bool = True,
    arrival: str = "arrival_us",
    tie: tuple[str, ...] = (),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Adds ``reason``: null for an accepted event.

    The first arrival of an id opens a time to live; a repeat inside it is a duplicate and does not renew
    it; a repeat exactly ``ttl`` later is accepted and opens the next one. ``dedup=False`` accepts
    everything with an id, as when the store is unavailable. ``arrival`` is a bigint of microseconds. A null id is
    an empty one.
    """
    life = duration_micros(ttl)
    life = life if life > 0 else duration_micros(DEFAULT_TTL)
    empty = F.coalesce("event_id", F.lit("")) == ""
    (kept,) = free(df, "kept")
    if not dedup:
        return df.withColumn("reason", F.when(empty, EMPTY_ID))
    named = df.filter(~empty)
    order = [c for c in tie if c in df.columns]
    marked = first_per_window(named, ["event_id"], arrival, order, life, False, kept, hot_rows)
    judged = marked.withColumn("reason", F.when(~F.col(kept), DUPLICATE)).drop(kept)
    return judged.unionByName(df.filter(empty).withColumn("reason", F.lit(EMPTY_ID)))


def batch_counts(judged: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """``accepted`` and ``rejected`` per batch; counts combine before the shuffle. ``batches`` (``agent_id``,
    ``sequence``), if given, names all batches that came: those without events have zeros."""
    refused = F.col("reason").isNotNull()
    counts = judged.groupBy("agent_id", "sequence").agg(F.count_if(~refused).alias("accepted"), F.count_if(refused).alias("rejected"))
    if batches is None:
        return counts
    known = batches.select("agent_id", "sequence").distinct().select(F.col("agent_id").alias("a"), F.col("sequence").alias("s"))
    same = F.col("agent_id").eqNullSafe(F.col("a")) & F.col("sequence").eqNullSafe(F.col("s"))
    zero = F.lit(0).cast("bigint")
    return known.join(counts, same, "left").select(
        F.col("a").alias("agent_id"), F.col("s").alias("sequence"), F.coalesce("accepted", zero).alias("accepted"), F.coalesce("rejected", zero).alias("rejected")
    )


def rejection_lists(judged: DataFrame, size: int = LISTED) -> DataFrame:
    """The rejected events of each batch with their reasons, in numbered lists of about ``size``: one list for an
    ordinary batch, and as many as it takes for one that was refused as a whole."""
    refused = judged.filter("reason IS NOT NULL").select("agent_id", "sequence", "event_id", "reason")
    wide = refused.groupBy("agent_id", "sequence").agg(F.ceil(F.count(F.lit(1)) / size).alias("lists")).filter("lists > 1")
    wide = wide.select(F.col("agent_id").alias("a"), F.col("sequence").alias("s"), "lists")
    same = F.col("agent_id").eqNullSafe(F.col("a")) & F.col("sequence").eqNullSafe(F.col("s"))
    number = F.pmod(F.xxhash64("event_id", F.monotonically_increasing_id()), F.coalesce("lists", F.lit(1)))
    dealt = refused.join(lookup_side(wide), same, "left").withColumn("list", number)
    listed = F.array_sort(F.collect_list(F.struct("event_id", "reason"))).alias("rejected_events")
    return dealt.groupBy("agent_id", "sequence", "list").agg(listed)


def summarise(judged: DataFrame) -> DataFrame:
    """Accepted and rejected per batch with the list of rejected events, for batches of a bounded size as
    ``assign_batches`` makes them; ``batch_counts`` and ``rejection_lists`` bound every row for any."""
    refused = F.col("reason").isNotNull()
    return judged.groupBy("agent_id", "sequence").agg(
        F.count_if(~refused).alias("accepted"),
        F.count_if(refused).alias("rejected"),
        F.array_sort(F.collect_list(F.when(refused, F.struct("event_id", "reason")))).alias("rejected_events"),
    )


def ingest(df: DataFrame, ttl: str = DEFAULT_TTL, dedup: bool = True, **options) -> Ingested:
    judged = reject_reason(df, ttl, dedup, **options)
    return Ingested(
        judged.filter("reason IS NULL").drop("reason"),
        judged.filter("reason IS NOT NULL").select("event_id", "reason", "agent_id", "sequence"),
        summarise(judged),
    )
