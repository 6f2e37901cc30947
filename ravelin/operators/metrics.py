"""Queries over metric samples ``(ts, metric, labels, value)``: rates, histograms, quantiles, gauges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.durations import duration_micros
from ravelin.functions.maps import sorted_map
from ravelin.functions.names import hidden

# Upper bounds of the latency buckets, in seconds.
LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 5.0]
INFINITE = float("inf")
SLAB_WINDOWS = 64


def series_key(labels: str = "labels") -> Column:
    """Text that identifies a label set, whatever the order of its entries."""
    return F.to_json(sorted_map(F.col(labels)))


def counter_rate(samples: DataFrame, keys: Sequence[str], ts: str = "ts_us", value: str = "value", window: str = "60s") -> DataFrame:
    """Per sample: increase per second over the window that ends at it, as ``rate``.

    Increases count between neighbours that both lie in the window; after a reset the new value is the
    increase. ``ts`` is a bigint of microseconds. A series is cut into slabs of time; a sample also goes
    to the next slab while it is inside that slab's first window, so a long series spreads over tasks. Samples of
    one time go by their value. Other columns may have any names.
    """
    samples, name, back = hidden(samples, {"home", "slab", "step"})
    keys, ts, value = [name(k) for k in keys], name(ts), name(value)
    span = duration_micros(window)
    slab = span * SLAB_WINDOWS
    home = F.floor(F.col(ts) / F.lit(slab)).cast("bigint")
    reach = F.floor((F.col(ts) + span - 1) / F.lit(slab)).cast("bigint")
    spread = samples.withColumn("home", home).withColumn("slab", F.explode(F.sequence(F.col("home"), reach)))
    along = Window.partitionBy(*keys, "slab").orderBy(ts)
    before = F.lag(value).over(Window.partitionBy(*keys, "slab").orderBy(ts, value))
    grown = F.when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    inside = along.rangeBetween(-(span - 1), 0)
    stepped = spread.withColumn("step", F.when(before.isNull(), 0.0).otherwise(grown))
    total = F.sum("step").over(inside) - F.min(F.struct(ts, value, "step")).over(inside)["step"]
    return back(stepped.withColumn("rate", total / (span / 1_000_000)).filter(F.col("slab") == F.col("home")), "rate")


def bucketize(
    observations: DataFrame, keys: Sequence[str], column: str, bounds: Sequence[float] = tuple(LATENCY_BOUNDS)
) -> DataFrame:
    """Cumulative histogram ``(keys, le, count)`` with an infinite last bucket.

    Each value goes to its own bucket first, so the shuffle carries one row per key and bucket. Null values
    are no observations.
    """
    observations = observations.filter(F.col(column).isNotNull())
    limits = [*bounds, INFINITE]
    own = F.lit(INFINITE)
    for bound in reversed(bounds):
        own = F.when(F.col(column) <= bound, F.lit(float(bound))).otherwise(own)
    counted = (
        observations.groupBy(*keys, own.alias("le")).agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("le", "n"))).alias("own"))
    )
    filled = counted.select(*keys, "own", F.explode(F.array(*[F.lit(float(b)) for b in limits])).alias("le"))
    below = F.filter(F.map_entries("own"), lambda e: e["key"] <= F.col("le"))
    total = F.aggregate(below, F.lit(0).cast("bigint"), lambda s, e: s + e["value"])
    return filled.select(*keys, "le", total.alias("count"))


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], q: float, le: str = "le", count: str = "count") -> DataFrame:
    """Linear interpolation inside the bucket that holds rank ``q``; one row per key set.

    A rank in the infinite bucket gives the highest finite bound; an empty histogram gives null; rank zero
    in an empty first bucket gives that bucket's lower end.
    """
    ladder = F.array_sort(F.collect_list(F.struct(F.col(le).alias("le"), F.col(count).cast("double").alias("n"))))
    rows = buckets.groupBy(*keys).agg(ladder.alias("ladder"))
    return rows.select(*keys, _ladder_value(F.lit(q)).alias("quantile"))


def _ladder_value(q: Column) -> Column:
    """The quantile of the cumulative buckets in ``ladder``."""
    total = F.element_at("ladder", -1)["n"]
    rank = q * total
    place = F.array_position(F.transform("ladder", lambda b: b["n"] >= rank), F.lit(True)).cast("int")
    here = F.element_at("ladder", place)
    prior = F.try_element_at("ladder", F.when(place > 1, place - 1))
    low = F.when(place == 1, 0.0).otherwise(prior["le"])
    under = F.when(place == 1, 0.0).otherwise(prior["n"])
    inside = low + (here["le"] - low) * F.coalesce(F.try_divide(rank - under, here["n"] - under), F.lit(0.0))
    value = (
        F.when(here["le"] == INFINITE, low)
        .when((place == 1) & (here["le"] <= 0), here["le"])
        .otherwise(inside)
    )
    return F.when((total > 0) & (place > 0), value)


def quantile_of_rate(samples: DataFrame, keys: Sequence[str], q: Sequence[float], ts: str = "ts_us", le: str = "le", value: str = "value", window: str = "300s") -> DataFrame:
    """Quantiles of what came in during the window before each sample: bucket counters ``(keys, le, ts, value)``
    to rates, and the rates of one time to ``q`` and ``quantile``. One rate and one ladder serve all ``q``; buckets
    are sampled at the same times. Rates are increases over the window, not drawn out to its edges."""
    rated = counter_rate(samples, [*keys, le], ts, value, window)
    ladder = F.array_sort(F.collect_list(F.struct(F.col(le).alias("le"), F.col("rate").alias("n"))))
    rows = rated.groupBy(*keys, ts).agg(ladder.alias("ladder")).withColumn("q", F.explode(F.array(*[F.lit(float(x)) for x in q])))
    return rows.select(*keys, ts, "q", _ladder_value(F.col("q")).alias("quantile"))


def latest(samples: DataFrame, keys: Sequence[str], ts: str = "ts_us", value: str = "value") -> DataFrame:
    """The newest value of each series; combines before the shuffle."""
    return samples.groupBy(*keys).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))
