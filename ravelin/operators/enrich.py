"""Enrichment: each enricher is ``DataFrame -> DataFrame`` and writes keys into ``metadata``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.maps import from_pairs, upsert
from ravelin.functions.net import ipv4_number, is_private_or_loopback
from ravelin.schema import empty_map

# The built-in threat list.
DEFAULT_THREATS = {
    "185.220.101.34": "tor_exit",
    "185.220.101.35": "tor_exit",
    "104.244.76.13": "tor_exit",
    "71.6.135.131": "scanner",
    "162.142.125.10": "scanner",
    "198.235.24.0": "researcher",
}

BROADCAST_ROWS = 1_000_000
ERRORS = "enrich_errors"
PREFIX_BITS = 16

Enricher = Callable[[DataFrame], DataFrame]


def default_threats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_THREATS.items()), "source_ip string, category string")


def lookup_side(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a dimension only when a count shows that it is small. Above the bound it stays a
    shuffle join, where adaptive execution splits skewed partitions of the event side."""
    return F.broadcast(dim) if dim.limit(max_rows + 1).count() <= max_rows else dim


def put_metadata(df: DataFrame, entries: Column, keys: Sequence[str]) -> DataFrame:
    """Write the map column ``entries``, whose keys are among ``keys``, over the metadata.

    A null map counts as empty on either side. Only rows that already have one of the keys pay for
    the removal of old entries.
    """
    staged = df.withColumn("new_metadata", F.coalesce(entries, empty_map()))
    old, new = F.coalesce(F.col("metadata"), empty_map()), F.col("new_metadata")
    clash = reduce(Column.__or__, [F.map_contains_key(old, key) for key in keys])
    merged = F.when(clash, upsert(old, new)).otherwise(F.map_concat(old, new))
    return staged.withColumn("metadata", merged).drop("new_metadata")


def text_map(**pairs: str | Column) -> Column:
    return F.create_map(*[part if isinstance(part, Column) else F.lit(part) for pair in pairs.items() for part in pair])


def geo_enrich(df: DataFrame) -> DataFrame:
    """``geo_is_private`` and ``geo_country`` for a source ip that parses; nothing otherwise."""
    entries = F.when(F.col("is_local"), text_map(geo_is_private="true", geo_country="PRIVATE")).when(
        ~F.col("is_local"), text_map(geo_is_private="false", geo_country="UNKNOWN")
    )
    tested = df.withColumn("is_local", is_private_or_loopback(F.col("source_ip")))
    return put_metadata(tested, entries, ["geo_is_private", "geo_country"]).drop("is_local")


def threat_enrich(df: DataFrame, threats: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Exact lookup of ``source_ip``. A miss leaves a ``threat_category`` the producer supplied."""
    dim = threats.groupBy("source_ip").agg(F.min("category").alias("threat_hit"))
    joined = df.join(lookup_side(dim, max_rows), "source_ip", "left")
    named = F.col("source_ip") != ""
    hit = named & F.col("threat_hit").isNotNull()
    entries = F.when(hit, text_map(threat_known="true", threat_category=F.col("threat_hit"))).when(
        named, text_map(threat_known="false")
    )
    return put_metadata(joined, entries, ["threat_known", "threat_category"]).select(*df.columns)


def ip_range_enrich(df: DataFrame, ranges: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Country, city and network of an IPv4 source; of ranges that overlap the narrowest counts.

    ``ranges`` has ``first_ip, last_ip`` (dotted) and ``country, city, asn``. A range is spread over the
    /16 prefixes it touches, so the join is an equality on the prefix; all ranges of a prefix are one row,
    narrowest first, so no event is multiplied.
    """
    block = 1 << (32 - PREFIX_BITS)
    low, high = ipv4_number(F.col("first_ip")), ipv4_number(F.col("last_ip"))
    spread = ranges.select(
        low.alias("range_low"), high.alias("range_high"), "country", "city", "asn"
    ).withColumn(
        "prefix",
        F.explode(F.sequence(F.floor(F.col("range_low") / block), F.floor(F.col("range_high") / block))),
    )
    order = F.struct((F.col("range_high") - F.col("range_low")).alias("width"), "range_low", "range_high", "country", "city", "asn")
    spread = spread.groupBy("prefix").agg(F.array_sort(F.collect_set(order)).alias("held"))
    number = ipv4_number(F.col("source_ip"))
    keyed = df.withColumn("ip_number", number).withColumn("prefix", F.floor(F.col("ip_number") / block))
    side = lookup_side(spread, max_rows).alias("r")
    found = keyed.alias("e").join(side, F.col("e.prefix") == F.col("r.prefix"), "left")
    inside = F.filter("r.held", lambda x: F.col("e.ip_number").between(x["range_low"], x["range_high"]))
    filled = found.select("e.*", F.get(inside, 0).alias("hit")).select("*", "hit.country", "hit.city", "hit.asn")
    pairs = {"geo_country": F.col("country"), "geo_city": F.col("city"), "geo_asn": F.col("asn").cast("string")}
    entries = F.when(F.col("country").isNotNull(), from_pairs(pairs))
    return put_metadata(filled, entries, list(pairs)).select(*df.columns)


def guarded(name: str, keys: dict[str, Column], failure: Column) -> Enricher:
    """An enricher for expressions that may fail per row: where ``failure`` is not null the row keeps its
    metadata and the text goes to ``enrich_errors``. Write the keys with ``try_*`` functions."""

    def apply(df: DataFrame) -> DataFrame:
        errors = F.col(ERRORS) if ERRORS in df.columns else F.array().cast("array<string>")
        message = F.when(failure.isNotNull(), F.concat(F.lit(f"{name}: "), failure.cast("string")))
        out = put_metadata(df, F.when(failure.isNull(), from_pairs(keys)), list(keys))
        return out.withColumn(ERRORS, F.concat(errors, F.array_compact(F.array(message))))

    return apply


def enrich(df: DataFrame, enrichers: Sequence[Enricher]) -> DataFrame:
    """Apply the enrichers in order; later keys overwrite. A failed row still goes on, and
    ``element_at(enrich_errors, 1)`` is the first error."""
    out = df.withColumn("metadata", F.coalesce(F.col("metadata"), empty_map()))
    if ERRORS not in out.columns:
        out = out.withColumn(ERRORS, F.array().cast("array<string>"))
    for step in enrichers:
        out = step(out)
    return out
