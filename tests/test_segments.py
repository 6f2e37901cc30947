"""Address ranges as disjoint segments against a plain search."""

import bisect
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from ravelin.functions.net import ip_point
from ravelin.operators import segments
from ravelin.operators.segments import count_up_to, number
from ravelin.schema import normalise_events

SHAPE = "first_ip string, last_ip string, country string, city string, asn long"


def value(ip):
    try:
        found = ipaddress.ip_address(ip)
    except ValueError:
        return None
    return int(found) + (0xFFFF << 32 if found.version == 4 else 0)


def test_points_order_as_addresses(spark):
    texts = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "::", "::1", "::ffff:1.2.3.4", "1::", "2001:db8::8:800:200c:417a", "FFFF:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "1:2:3:4:5:6:7:8", "fe80::1:2", "8000::", "7fff::", "::5:1.2.3.4", "64:ff9b::1.2.3.4", "01.2.3.4", "x", "", None, "1:2", "1.2.3", "fe80::1%eth0"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ip_point(F.col("t")).alias("p")).collect()
    assert {r["t"]: segments.number(*r["p"]) if r["p"] else None for r in rows} == {t: value(t) if t and "%" not in t else None for t in texts}


@pytest.mark.parametrize("part,chunk", [(10**6, 1_024), (40, 3), (7, 1)])
def test_segments_equal_a_plain_search(spark, part, chunk):
    rng = random.Random(part)
    ranges = []
    for i in range(150):
        six = i % 4 == 0
        base = (0x20010DB8 << 96) + rng.randrange(1 << 20) if six else (0xFFFF << 32) + (10 << 24) + rng.randrange(1 << 14)
        size = rng.choice([1, 5, 300, 5_000, 1 << 14])
        make = ipaddress.IPv6Address if six else (lambda n: ipaddress.IPv4Address(n - (0xFFFF << 32)))
        ranges.append((str(make(base)), str(make(base + size - 1)), f"C{i % 9}", f"c{i}", i))
    ranges += [ranges[3], ranges[5][:4] + (None,), ("9.9.9.9", "1.1.1.1", "X", "x", 1), ("bad", "1.1.1.1", "X", "x", 1), (None, None, "X", "x", 1), ("0.0.0.0", "255.255.255.255", "ALL", "all", 0)]
    asked = [str(ipaddress.IPv4Address((10 << 24) + rng.randrange(1 << 15))) for _ in range(200)] + [str(ipaddress.IPv6Address((0x20010DB8 << 96) + rng.randrange(1 << 20))) for _ in range(200)]
    asked += [r[i] for r in ranges[:60] for i in (0, 1)] + ["", "x", None, "::", "ffff::", "::ffff:10.0.0.5"]
    raw = spark.createDataFrame([(f"e{i}", ip, {"k": "v"}) for i, ip in enumerate(asked)], "event_id string, source_ip string, metadata map<string,string>")
    chunks = segments.segment_chunks(spark.createDataFrame(ranges, SHAPE), part, chunk)
    out = segments.ip_segment_enrich(normalise_events(raw).withColumn("chunk", F.lit("mine")), chunks)
    got = {r["event_id"]: (r["metadata"].get("geo_country"), r["metadata"].get("geo_city"), r["chunk"]) for r in out.collect()}
    plain = [(value(a), value(b), c, d) for a, b, c, d, _ in ranges if a and value(a) is not None and value(b) is not None]
    for i, ip in enumerate(asked):
        at = value(ip or "")
        held = sorted((b - a, a, b, c, d) for a, b, c, d in plain if at is not None and a <= at <= b)
        assert got[f"e{i}"] == ((held[0][3], held[0][4]) if held else (None, None)) + ("mine",), ip
    if chunk == 1_024:
        assert chunks.count() == 1


def test_no_ranges(spark):
    none = segments.segment_chunks(spark.createDataFrame([], SHAPE))
    events = normalise_events(spark.createDataFrame([("e", "1.2.3.4")], "event_id string, source_ip string"))
    assert segments.ip_segment_enrich(events, none).collect()[0]["metadata"] == {}


def test_addresses_parse_by_a_small_expression(spark):
    """The expression names the address a bounded number of times: nested copies of it took a millisecond a row."""
    plan = spark.createDataFrame([], "address string").select(ip_point(F.col("address")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("address#") < 40
    texts = ["1:2:3:4:5:6:7:8", "::", "::1", "1::", "a::b:0c", "ABCD:0:0:00Ef::", "::ffff:10.2.3.4", "1:2:3:4:5:6:10.20.30.255", "fe80::0000:1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ip_point(F.col("t")).alias("p")).collect()
    for row in rows:
        told = ipaddress.IPv6Address(row["t"])
        assert number(row["p"]["hi"], row["p"]["lo"]) == int(told), row["t"]
    bad = spark.createDataFrame([("1::2::3",), ("::1.2.3.256",), ("",), (None,), ("1:2:3:4:5:6:7",), ("::1\n",)], "t string")
    assert [r["p"] for r in bad.select(ip_point(F.col("t")).alias("p")).collect()] == [None] * 6


def test_search_reads_one_point_a_step(spark):
    for size in (0, 1, 2, 3, 7, 8, 100):
        points = [3 * i for i in range(size)]
        array = F.array(*map(F.lit, points)) if points else F.expr("cast(array() as array<int>)")
        held = F.transform(array, lambda p: F.struct(p.alias("low")))
        asked = spark.range(-2, 3 * size + 3).select(F.col("id").cast("int").alias("x"), array.alias("points"), held.alias("held"))
        rows = asked.select("x", count_up_to(F.col("points"), F.col("x"), F.lit(size)).alias("n"), count_up_to(F.col("held"), F.col("x"), F.size("held"), "low").alias("m")).collect()
        for x, n, m in rows:
            assert n == m == bisect.bisect_right(points, x)
