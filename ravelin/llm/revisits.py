"""Resolution of not-modified revisits in crawl records.

A revisit record says that a page had not changed. It is resolved by an as-of join to the latest full response of the
same canonical URL before it, if their validators agree; the stored headers are then updated by those that such an
answer may change. Records are dealt by ranges of (URL, time), so a busy URL is spread over many tasks; what its
earlier ranges end with is carried over as one row per URL and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import materialise

#: Fixed value: header fields that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "utm_"  # query parameters with this prefix do not tell pages apart

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme and usual port, path, and sorted query parameters without tracking ones; no
    fragment. What has no scheme is only trimmed and freed of its fragment."""
    u = F.regexp_replace(F.trim(url), r"#[^\n]*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, _SCHEME + "([^/?]*)", 1)), ":(80|443)$", "")
    path = F.regexp_extract(u, _SCHEME + "[^/?]*([^?]*)", 1)
    params = F.array_sort(F.filter(F.split(F.regexp_extract(u, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(u.rlike(_SCHEME), F.concat(host, F.when(path == "", "/").otherwise(path), query)).otherwise(u)


def outcome(etag: Column, last_modified: Column, full: Column) -> Column:
    """Entity tags decide where both have one, compared weakly; else the modification dates do."""

    def strong(tag: Column) -> Column:
        return F.regexp_replace(tag, "^W/", "")

    tags = F.when(strong(etag) == strong(full["etag"]), "resolved").otherwise("mismatch")
    dates = F.when(last_modified == full["last_modified"], "resolved").otherwise("mismatch")
    verdict = F.when(etag.isNotNull() & full["etag"].isNotNull(), tags).when(last_modified.isNotNull() & full["last_modified"].isNotNull(), dates)
    return F.when(full["record_id"].isNull(), "orphan").otherwise(F.coalesce(verdict, F.lit("unverified")))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored header fields, replaced by the permitted ones of the revisit; names are in lower case."""
    empty = F.create_map().cast("map<string,string>")
    stored, fresh = F.coalesce(stored, empty), F.coalesce(fresh, empty)
    update = F.map_filter(fresh, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit with ``canonical_url``, ``outcome``, ``response_id``, and, if resolved, the response's
    ``payload`` reference and the merged ``headers``.

    ``records`` has ``record_id``, ``url``, ``kind`` (``response`` or ``revisit``; others are ignored), ``fetched_at``
    (a number, whole or fractional), ``etag``, ``last_modified``, ``headers`` (map) and ``payload``, a reference to the stored content. A
    response at the very time of a revisit is not before it; of responses at one time the largest ``record_id``
    counts. A revisit without URL or time is an orphan, a response without them answers for none. Repeated revisits
    give repeated rows."""
    columns = ["record_id", "kind", "fetched_at", "etag", "last_modified", "headers", "payload"]
    rows = records.filter("kind IN ('response', 'revisit')").select(*columns, canonical_url(F.col("url")).alias("canonical_url"))
    placed = F.col("canonical_url").isNotNull() & F.col("fetched_at").isNotNull()
    full = F.struct("fetched_at", "record_id", "etag", "last_modified", "payload", F.to_json("headers").alias("stored"))
    dealt = rows.filter(placed).repartitionByRange("canonical_url", "fetched_at")
    dealt = materialise(dealt.withColumn("slab", F.spark_partition_id()).withColumn("full", F.when(F.col("kind") == "response", full)))
    tails = dealt.groupBy("canonical_url", "slab").agg(F.max("full").alias("tail"))
    before = Window.partitionBy("canonical_url").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(F.col("canonical_url").alias("u"), F.col("slab").alias("s"), F.last("tail", ignorenulls=True).over(before).alias("carried")).filter("carried IS NOT NULL")
    # At one time revisits stand before responses, so the rows before a revisit are earlier, in whatever unit.
    earlier = Window.partitionBy("canonical_url", "slab").orderBy("fetched_at", F.col("kind") == "response").rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumn("own", F.max("full").over(earlier)).filter("kind = 'revisit'").drop("full")
    found = found.join(carried, (F.col("canonical_url") == F.col("u")) & (F.col("slab") == F.col("s")), "left")
    found = found.select(*columns, "canonical_url", F.coalesce("own", "carried").alias("full"))
    lost = rows.filter(~placed & (F.col("kind") == "revisit")).select(*columns, "canonical_url", F.lit(None).cast(found.schema["full"].dataType).alias("full"))
    both = found.union(lost).withColumn("outcome", outcome(F.col("etag"), F.col("last_modified"), F.col("full")))
    good = F.col("outcome") == "resolved"
    stored = F.from_json(F.col("full.stored"), "map<string,string>")
    return both.select(
        "record_id",
        "canonical_url",
        "outcome",
        F.col("full.record_id").alias("response_id"),
        F.when(good, F.col("full.payload")).alias("payload"),
        F.when(good, merged_headers(stored, F.col("headers"))).alias("headers"),
    )
