"""Baselines and delivery statistics. The semantics of these reports are defined here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.durations import duration_micros
from ravelin.operators.delivery import SENT


def baseline_anomalies(
    events: DataFrame, keys: Sequence[str], ts: str, bucket: str = "1h", history: int = 24, limit: float = 3.0
) -> DataFrame:
    """Buckets whose count lies more than ``limit`` standard deviations over the ``history`` buckets before.

    Empty buckets count zero; a bucket needs a full history since the key's first one and a history that
    varies. ``ts`` is a bigint of microseconds. Events are counted per bucket before anything is compared.
    """
    width = duration_micros(bucket)
    counts = events.groupBy(*keys, F.floor(F.col(ts) / F.lit(width)).cast("bigint").alias("bucket")).agg(
        F.count(F.lit(1)).alias("events")
    )
    along = Window.partitionBy(*keys).orderBy("bucket")
    past = along.rangeBetween(-history, -1)
    n = F.lit(float(history))
    # Counts are taken around a whole number near the key's mean, as doubles: sums of squares stay small and exact.
    centre = F.floor(F.avg("events").over(Window.partitionBy(*keys))).cast("double")
    apart = F.col("events").cast("double") - F.col("centre")
    absent = n - F.count(F.lit(1)).over(past)
    total = F.coalesce(F.sum(apart).over(past), F.lit(0.0)) - absent * F.col("centre")
    squares = F.coalesce(F.sum(apart * apart).over(past), F.lit(0.0)) + absent * F.col("centre") * F.col("centre")
    variance = F.greatest(squares - total * total / n, F.lit(0.0)) / (n - 1)
    scored = (
        counts.withColumn("centre", centre)
        .withColumn("first_bucket", F.min("bucket").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("mean", F.col("centre") + total / n)
        .withColumn("deviation", F.sqrt(variance))
        .filter((F.col("bucket") >= F.col("first_bucket") + history) & (F.col("deviation") > 0) & ~F.isnan("deviation"))
        .withColumn("score", (F.col("events") - F.col("mean")) / F.col("deviation"))
    )
    return scored.filter(F.col("score") > limit).select(*keys, "bucket", "events", "mean", "deviation", "score")


def delivery_analytics(receipts: DataFrame, day: Column) -> DataFrame:
    """Deliveries and failure rate per channel, status-independent, per day."""
    failed = F.col("status") != SENT
    return receipts.groupBy("channel", day.alias("day")).agg(
        F.count(F.lit(1)).alias("deliveries"),
        F.count_if(failed).alias("failures"),
        (F.count_if(failed) / F.count(F.lit(1))).alias("failure_rate"),
        F.sum("attempts").alias("attempts"),
    )


def sla_compliance(deliveries: DataFrame, targets_micros: dict[str, int], delay: str = "delay_us") -> DataFrame:
    """Share of deliveries within the target of their severity; null for a severity without a target."""
    target = F.lit(None).cast("bigint")
    for severity, micros in targets_micros.items():
        target = F.when(F.col("severity") == severity, F.lit(micros)).otherwise(target)
    met = F.col(delay) <= target
    return (
        deliveries.groupBy("severity")
        .agg(F.count(F.lit(1)).alias("deliveries"), F.count_if(met).alias("met"), F.max(target).isNotNull().alias("known"))
        .select(
            "severity",
            "deliveries",
            F.when(F.col("known"), F.col("met")).alias("within_target"),
            F.when(F.col("known"), F.col("met") / F.col("deliveries")).alias("compliance"),
        )
    )
