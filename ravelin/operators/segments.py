"""Address ranges as disjoint segments: one winner for every address, found by binary search.

Ranges may overlap; the narrowest counts. A sweep over their borders turns them into segments that do not overlap. It
runs in parts cut at sampled addresses, and a range takes part in each it reaches, so no task holds all ranges. Segments
are packed in order into chunks; an event finds its chunk by a search in the chunks' first addresses, a bounded array,
meets it by an equality join and finds its segment by a search inside: a logarithm of the ranges in all. IPv4 and IPv6
are one line of 128-bit numbers, on which a mapped IPv4 address is its IPv4 address.
"""

from __future__ import annotations

import heapq
import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.maps import from_pairs
from ravelin.functions.names import free
from ravelin.functions.net import ip_point
from ravelin.operators.enrich import lookup_side, put_metadata
from ravelin.session import materialise

PART_RANGES = 100_000  # ranges of one part of the sweep, about
SAMPLED = 20  # sampled addresses per part
CHUNK = 1_024  # segments of a chunk at least
MOST_CHUNKS = 50_000
LOW = -(1 << 63)
POINT = "struct<hi:bigint,lo:bigint>"
CHUNK_SQL = f"first {POINT}, held array<struct<low:{POINT},high:{POINT},country:string,city:string,asn:string>>"


def number(hi: int, lo: int) -> int:
    """A point as a whole number; points hold both halves shifted, so that they order as signed numbers."""
    return (hi - LOW) << 64 | (lo - LOW)


def point(n: int) -> dict:
    return {"hi": (n >> 64) + LOW, "lo": (n & (1 << 64) - 1) + LOW}


def swept(ranges: list[tuple], low: int, high: int) -> list[tuple]:
    """Disjoint segments ``(low, high, country, city, asn)`` of ``ranges`` (like them) from ``low`` up to ``high``: each
    address has the narrowest range that holds it; equal widths go by the range itself."""
    ordered = sorted(((max(r[0], low), r) for r in ranges if r[0] <= high and r[1] >= low), key=lambda x: x[0])
    borders = sorted({b for start, r in ordered for b in (start, min(r[1], high) + 1)})
    out, active, next_range = [], [], 0
    for at, until in zip(borders, borders[1:]):
        while next_range < len(ordered) and ordered[next_range][0] <= at:
            r = ordered[next_range][1]
            heapq.heappush(active, (r[1] - r[0], r[0], r[1], *((x is not None, x or "") for x in r[2:]), r))
            next_range += 1
        while active and active[0][2] < at:
            heapq.heappop(active)
        if not active:
            continue
        told = active[0][-1][2:]
        if out and out[-1][1] == at - 1 and out[-1][2:] == told:
            out[-1] = (out[-1][0], until - 1, *told)
        else:
            out.append((at, until - 1, *told))
    return out


def count_up_to(points: Column, x: Column, size: Column, part: str | None = None) -> Column:
    """How many of the ordered ``points`` (their field ``part``, if named) are ``x`` at most: from the highest bit of
    ``size`` down, a bit belongs to the answer if the point it leads to is ``x`` at most. A step reads one point."""
    bits = F.sequence(F.ceil(F.log2(size + 1)).cast("int"), F.lit(0), F.lit(-1))

    def take(found: Column, bit: Column) -> Column:
        ahead = found + F.call_function("shiftleft", F.lit(1), bit)
        at = F.get(points, ahead - 1)  # null beyond the last point
        return F.when((at[part] if part else at) <= x, ahead).otherwise(found)

    return F.aggregate(bits, F.lit(0), take)


def literal_points(points: list[dict]) -> Column:
    return F.from_json(F.lit(json.dumps(points)), f"array<{POINT}>")


def segment_chunks(ranges: DataFrame, part_ranges: int = PART_RANGES, chunk: int = CHUNK) -> DataFrame:
    """Chunks of disjoint segments (``first``, ``held``) of ``ranges`` (``first_ip``, ``last_ip``, ``country``, ``city``,
    ``asn``). Ranges whose ends do not parse, or end before they begin, are left out."""
    rows = ranges.select(ip_point(F.col("first_ip")).alias("low"), ip_point(F.col("last_ip")).alias("high"), "country", "city", F.col("asn").cast("string").alias("asn"))
    rows = materialise(rows.filter("low IS NOT NULL AND high IS NOT NULL AND low <= high"))
    n = rows.count()
    parts = max(1, -(-n // part_ranges))
    wanted = parts * SAMPLED
    sample = sorted(tuple(r["low"]) for r in rows.select("low").sample(min(1.0, 1.5 * wanted / max(n, 1)), 7).collect()) if parts > 1 else []
    cuts = sorted({number(*sample[i * len(sample) // parts]) for i in range(1, parts)}) if sample else []
    width = max(chunk, math.ceil(2 * n / MOST_CHUNKS))
    ends = [-1, *(c - 1 for c in cuts), (1 << 128) - 1]
    if cuts:
        known, size = literal_points([point(c) for c in cuts]), F.lit(len(cuts))
        first, last = count_up_to(known, F.col("low"), size), count_up_to(known, F.col("high"), size)
        spread = rows.withColumn("part", F.explode(F.sequence(first, last)))
    else:
        spread = rows.withColumn("part", F.lit(0))
    kind = pa.struct([("hi", pa.int64()), ("lo", pa.int64())])
    held = pa.list_(pa.struct([("low", kind), ("high", kind), ("country", pa.string()), ("city", pa.string()), ("asn", pa.string())]))

    def sweep(key, table):
        part = key[0].as_py()
        read = [(number(**r["low"]), number(**r["high"]), r["country"], r["city"], r["asn"]) for r in table.to_pylist()]
        found = swept(read, ends[part] + 1, ends[part + 1])
        told = [{"low": point(a), "high": point(b), "country": c, "city": d, "asn": e} for a, b, c, d, e in found]
        chunks = [told[i : i + width] for i in range(0, len(told), width)]
        return pa.table([pa.array([c[0]["low"] for c in chunks], kind), pa.array(chunks, held)], names=["first", "held"])

    return materialise(spread.groupBy("part").applyInArrow(sweep, CHUNK_SQL))


def ip_segment_enrich(df: DataFrame, chunks: DataFrame) -> DataFrame:
    """Country, city and network of an IPv4 or IPv6 source, from ``segment_chunks``: of ranges that hold it the
    narrowest. An address that does not parse, or lies in no range, gets no keys."""
    firsts = sorted(tuple(r["first"]) for r in chunks.select("first").collect())  # MOST_CHUNKS and one per part at most
    at, place, chunk, number_, hit_ = free(df, "at_point", "chunk_place", "chunk", "of_chunk", "segment_hit")
    known, size = literal_points([{"hi": a, "lo": b} for a, b in firsts]), F.lit(len(firsts))
    found = df.withColumn(at, ip_point(F.col("source_ip"))).withColumn(place, F.when(F.col(at).isNotNull(), count_up_to(known, F.col(at), size)))
    side = lookup_side(chunks.select(count_up_to(known, F.col("first"), size).alias(number_), F.col("held").alias(chunk)))
    joined = found.join(side, F.col(place) == F.col(number_), "left")
    inside = F.get(F.col(chunk), count_up_to(F.col(chunk), F.col(at), F.size(chunk), "low") - 1)
    joined = joined.withColumn(hit_, F.when(F.col(chunk).isNotNull(), inside)).drop(chunk)
    hit = F.when(F.col(at) <= F.col(hit_)["high"], F.col(hit_))
    pairs = {"geo_country": hit["country"], "geo_city": hit["city"], "geo_asn": hit["asn"]}
    entries = F.when(hit["country"].isNotNull(), from_pairs(pairs))
    return put_metadata(joined, entries, list(pairs)).select(*df.columns)
