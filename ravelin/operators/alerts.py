"""Alerts: projection of rule results, suppression, rate limit, notification payload, routing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions.durations import duration_micros
from ravelin.functions.jsontext import canonical_json
from ravelin.functions.maps import sorted_map
from ravelin.functions.names import free, hidden
from ravelin.functions.times import micros, rfc3339
from ravelin.operators.ordered import HOT_ROWS, first_per_window, in_order
from ravelin.session import materialise
from ravelin.schema import ALERT_SCHEMA, empty_map, severity_rank

SENT, SUPPRESSED, RATE_LIMITED = "sent", "suppressed", "rate_limited"
# Fixed value: the subject of all alerts.
DISPATCH_SUBJECT = "alerts.dispatch"
TICKS_PER_CHUNK = 512
ONE_BUCKET = "one_bucket"
#: A bucket between two parts of a table: its key as text, the instant of its last tick, the tokens left then.
BUCKET_STATE = f"{ONE_BUCKET} string, origin bigint, tokens bigint"
#: Columns the token bucket adds meanwhile; a caller's columns of these names are set aside.
BUCKET_RESERVED = {ONE_BUCKET, "bucket_ts", "bucket_tie", "bucket_hash", "bucket_row", "origin", "tick", "cut", "admitted"}
HASHED = ["string", "long", "integer", "short", "byte", "double", "float", "boolean", "timestamp", "timestamp_ntz", "date", "binary"]


def to_alerts(results: DataFrame) -> DataFrame:
    """Rule results to alerts; the id is a hash, so a rerun gives the same alert."""
    # Fixed value: the text of an alert.
    described = F.format_string(
        "Rule '%s' fired for group '%s' (%d events)", "rule_name", "group_key", "event_count"
    )
    return results.select(
        F.sha2(F.concat_ws("\u0001", "rule_id", "group_key", "event_id"), 256).alias("alert_id"),
        "rule_id",
        "rule_name",
        "severity",
        F.col("timestamp").alias("created_at"),
        described.alias("description"),
        F.create_map(F.lit("group_key"), F.col("group_key")).alias("group_values"),
        "event_count",
        "event_ids",
        "tags",
        F.coalesce(F.col("metadata"), empty_map()).alias("enrichment"),
    )


def suppression_key() -> Column:
    return F.concat_ws("|", "rule_id", F.coalesce(F.col("group_values")["group_key"], F.lit("")))


def suppress(
    alerts: DataFrame, window: str = "300s", flag: str = "kept", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Mark the first alert per rule and group; later ones within the window are not kept. The mark is
    anchored on the first kept alert and is still set exactly ``window`` later. Runs on ``created_at``."""
    key, at = free(alerts, "suppression_key", "created_us")
    keyed = alerts.withColumn(key, suppression_key()).withColumn(at, F.coalesce(micros(F.col("created_at")), F.lit(0)))
    return first_per_window(keyed, [key], at, ["alert_id"], duration_micros(window), True, flag, hot_rows).drop(key, at)


def refill_micros(rate: float) -> int:
    """One token each ``1/rate`` seconds, but not more often than each millisecond."""
    return max(int(1e9 / rate) // 1000, 1000)


def _clamp_after(state: Column, tick: Column, arrivals: Column, capacity: int) -> Column:
    """A tick as a step of ``x -> min(hi, max(lo, x + d))``: refill up to capacity, then serve arrivals."""
    gained = tick - state["tick"]
    low = F.greatest(F.least(state["lo"] + gained, F.lit(capacity)) - arrivals, F.lit(0))
    high = F.greatest(F.least(state["hi"] + gained, F.lit(capacity)) - arrivals, F.lit(0))
    return F.struct(
        tick.alias("tick"), low.alias("lo"), high.alias("hi"), (state["d"] + gained - arrivals).alias("d")
    )


def token_bucket(
    df: DataFrame,
    ts: str,
    tie: str,
    interval_micros: int,
    capacity: int,
    keys: Sequence[str] = (),
    flag: str = "allowed",
    ticks_per_chunk: int = TICKS_PER_CHUNK,
) -> DataFrame:
    """Mark the rows a token bucket admits; see ``token_bucket_from``."""
    return token_bucket_from(df, None, ts, tie, interval_micros, capacity, keys, flag, ticks_per_chunk)[0]


def token_bucket_from(
    df: DataFrame,
    state: DataFrame | None,
    ts: str,
    tie: str,
    interval_micros: int,
    capacity: int,
    keys: Sequence[str] = (),
    flag: str = "allowed",
    ticks_per_chunk: int = TICKS_PER_CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` with what a token bucket admits, and the buckets afterwards (``BUCKET_STATE``). It starts full and gains one token at each multiple of
    ``interval_micros`` from the first row of the key. ``ts`` is a bigint of microseconds.

    ``keys=[]`` is one global bucket. Rows are counted per refill tick first. What a run of ticks does to
    the token count has the form ``min(hi, max(lo, x + d))``, which is closed under composition, so chunks
    of ticks are summed up in parallel; the ordered pass sees one row per chunk, for the global bucket in
    one task (a row per ``ticks_per_chunk`` busy ticks). Rows of one time go by ``tie``, then by their content; of
    equal rows as many are admitted as there are tokens. A row without time counts as at time zero. Null keys are
    keys like others, and other columns may have any names.

    With ``state``, the buckets of earlier rows, a bucket goes on where it stood; a row from before that instant
    counts as at it. So parts of a table in time order give what the whole table gives.
    """
    one = not keys
    df, name, back = hidden(df, BUCKET_RESERVED)
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() in HASHED]
    key = F.lit(ONE_BUCKET) if one else F.to_json(F.struct(*[F.col(name(k)) for k in keys]))
    keyed = df.withColumn(ONE_BUCKET, key).withColumn("bucket_ts", F.coalesce(name(ts), F.lit(0))).withColumn("bucket_tie", F.col(name(tie)))
    keyed = keyed.withColumn("bucket_hash", F.xxhash64(*plain)).withColumn("bucket_row", F.monotonically_increasing_id())
    keys, ts, order = [ONE_BUCKET], "bucket_ts", ["bucket_ts", "bucket_tie", "bucket_hash", "bucket_row"]
    origins = keyed.groupBy(*keys).agg(F.min(ts).alias("origin"), F.lit(capacity).cast("bigint").alias("at_start"))
    if state is not None:
        before = state.select(F.col(ONE_BUCKET).alias("of"), F.col("origin").alias("since"), F.col("tokens").alias("held"))
        origins = origins.join(before, F.col(ONE_BUCKET) == F.col("of"), "left").select(*keys, F.coalesce("since", "origin").alias("origin"), F.coalesce("held", "at_start").alias("at_start"))
    origins = materialise(origins)
    # The global bucket has one origin; per-key origins join adaptively, where hot partitions are split.
    starts = origins.drop("at_start")
    ticked = keyed.join(F.broadcast(starts) if one else starts, keys)
    ticked = ticked.withColumn(
        "tick", F.greatest(F.floor((F.col(ts) - F.col("origin")) / F.lit(interval_micros)).cast("bigint"), F.lit(0))
    )
    ticked = materialise(ticked.drop("origin"))  # read three times below, without what stands above it
    chunked = (
        ticked.groupBy(*keys, "tick")
        .agg(F.count(F.lit(1)).alias("arrivals"))
        .withColumn("chunk", F.floor(F.col("tick") / ticks_per_chunk).cast("bigint"))
        .groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("tick", "arrivals"))).alias("run"))
    )
    start = F.struct(
        (F.col("chunk") * ticks_per_chunk).alias("tick"),
        F.lit(0).cast("bigint").alias("lo"),
        F.lit(capacity).cast("bigint").alias("hi"),
        F.lit(0).cast("bigint").alias("d"),
    )
    summed = chunked.select(
        *keys,
        "chunk",
        F.aggregate("run", start, lambda s, e: _clamp_after(s, e["tick"], e["arrivals"], capacity)).alias("sum"),
    ).select(*keys, "chunk", "sum.*")
    entries = _chunk_entries(summed.join(origins.drop("origin"), keys), keys, capacity, ticks_per_chunk)
    ends = summed.join(entries, [*keys, "chunk"]).select(*keys, F.col("tick").alias("last"), F.least("hi", F.greatest("lo", F.col("entry") + F.col("d"))).alias("tokens"))
    ends = ends.groupBy(*keys).agg(F.max_by("tokens", "last").alias("tokens"), F.max("last").alias("last")).join(origins, keys)
    ends = ends.select(ONE_BUCKET, (F.col("origin") + F.col("last") * interval_micros).alias("origin"), "tokens")
    if state is not None:
        ends = ends.unionByName(state.join(ends.select(ONE_BUCKET), ONE_BUCKET, "left_anti").select(*ends.columns))
    opened = F.array(
        F.struct(
            (F.col("chunk") * ticks_per_chunk).alias("tick"),
            F.col("entry").alias("left"),
            F.lit(0).cast("bigint").alias("open"),
        )
    )

    def step(history: Column, e: Column) -> Column:
        last = F.element_at(history, -1)
        have = F.least(last["left"] + e["tick"] - last["tick"], F.lit(capacity))
        now = F.struct(
            e["tick"].alias("tick"), F.greatest(have - e["arrivals"], F.lit(0)).alias("left"), have.alias("open")
        )
        return F.concat(history, F.array(now))

    opens = (
        chunked.join(entries, [*keys, "chunk"])
        .select(*keys, F.inline(F.slice(F.aggregate("run", opened, step), 2, ticks_per_chunk)))
        .select(*keys, "tick", F.col("open").alias("tokens"))
    )
    within = Window.partitionBy(*keys, "tick").orderBy(*order)
    first_rows = (
        ticked.select(*keys, "tick", *order)
        .withColumn("place", F.row_number().over(within))
        .filter(F.col("place") <= capacity)
    )
    cuts = (
        first_rows.join(opens, [*keys, "tick"])
        .filter(F.col("place") <= F.col("tokens"))
        .groupBy(*keys, "tick")
        .agg(F.max(F.struct(*order)).alias("cut"))
    )
    admitted = F.coalesce(F.struct(*order) <= F.col("cut"), F.lit(False))
    return back(ticked.join(cuts, [*keys, "tick"], "left").withColumn("admitted", admitted), F.col("admitted").alias(flag)), ends


def _chunk_entries(summed: DataFrame, keys: list[str], capacity: int, ticks_per_chunk: int) -> DataFrame:
    """Tokens each chunk starts with. A chunk's own clamp ends at its last busy tick; the idle ticks up to
    the next chunk refill."""
    names = list(keys)
    schema = T.StructType([summed.schema[k] for k in names] + [summed.schema["chunk"], T.StructField("entry", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, at = capacity, 0
        for batch in batches:
            parts = zip(*[batch.column(n).to_pylist() for n in ("place", "chunk", "tick", "lo", "hi", "d", "at_start")])
            entries = []
            for place, chunk, tick, low, high, shift, start in parts:
                begins = chunk * ticks_per_chunk
                if place == 1:
                    tokens, at = start, 0
                tokens = min(capacity, tokens + begins - at)
                entries.append(tokens)
                tokens, at = min(high, max(low, tokens + shift)), tick
            columns = [batch.column(n) for n in (*names, "chunk")] + [pa.array(entries, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "chunk", "entry"])

    return in_order(summed, names, ["chunk"]).mapInArrow(run, schema)


def refill(rate: float, interval_micros: int | None, capacity: int | None) -> tuple[int, int]:
    """The interval of a token and what the bucket holds, which is twice the whole rate if not given."""
    return interval_micros or refill_micros(rate), 2 * int(rate) if capacity is None else capacity


def decide(
    alerts: DataFrame,
    window: str = "300s",
    rate: float = 100.0,
    keys: Sequence[str] = (),
    interval_micros: int | None = None,
    capacity: int | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Suppress, then limit the rate: ``decision`` is sent, suppressed or rate_limited.

    An alert that is rate-limited has already silenced its successors. The bucket holds twice the whole
    rate; it is global unless ``keys`` names columns (for example ``rule_id``).
    """
    kept, at, allowed = free(alerts, "kept", "created_us", "allowed")
    marked = suppress(alerts, window, kept, hot_rows).withColumn(at, F.coalesce(micros(F.col("created_at")), F.lit(0)))
    marked = materialise(marked)  # one suppression pass for both kinds of rows
    survivors = marked.filter(F.col(kept)).drop(kept)
    limited = token_bucket(
        survivors,
        at,
        "alert_id",
        *refill(rate, interval_micros, capacity),
        keys,
        allowed,
    )
    decided = limited.withColumn("decision", F.when(F.col(allowed), SENT).otherwise(RATE_LIMITED)).drop(allowed)
    silenced = marked.filter(~F.col(kept)).drop(kept).withColumn("decision", F.lit(SUPPRESSED))
    return decided.unionByName(silenced).drop(at)


def payload_column() -> Column:
    """The notification text; empty tags and empty enrichment print as null."""
    return canonical_json(
        F.struct(
            F.col("alert_id"),
            rfc3339(F.col("created_at")).alias("created_at"),
            F.col("description"),
            F.when(F.size("enrichment") > 0, sorted_map(F.col("enrichment"))).alias("enrichment"),
            F.col("event_count"),
            F.when(F.size("group_values") > 0, sorted_map(F.col("group_values"))).alias("group"),
            F.col("rule_id"),
            F.col("rule_name"),
            F.col("severity"),
            F.when(F.size("tags") > 0, F.col("tags")).alias("tags"),
        )
    )


def notification_payload(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("payload", payload_column())


def route(alerts: DataFrame, by_severity: bool = False) -> DataFrame:
    """The subject of each alert: one for all, or ``alerts.critical`` and so on by severity."""
    named = F.concat(F.lit("alerts."), F.lower(F.regexp_replace("severity", "^SEVERITY_", "")))
    return alerts.withColumn("subject", named if by_severity else F.lit(DISPATCH_SUBJECT))


def by_priority(alerts: DataFrame) -> DataFrame:
    """Adds ``place`` from 1: most severe first, oldest first among equals. Alerts are cut by ranges of that
    order and numbered inside each range; only the ranges' sizes meet."""
    order = [severity_rank(F.col("severity")).desc(), F.col("created_at"), F.col("alert_id")]
    ranged = materialise(alerts.repartitionByRange(*order).withColumn("slab", F.spark_partition_id()))
    before = Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = ranged.groupBy("slab").agg(F.count(F.lit(1)).alias("n")).select("slab", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    placed = ranged.withColumn("place", F.row_number().over(Window.partitionBy("slab").orderBy(*order)))
    return placed.join(F.broadcast(sizes), "slab").withColumn("place", F.col("place") + F.col("shift")).drop("slab", "shift")


def page(alerts: DataFrame, size: int, after: tuple[Column, Column] | None = None) -> DataFrame:
    """One page in ``(created_at, alert_id)`` order, starting after the last row of the page before."""
    rows = alerts
    if after is not None:
        at, name = after
        rows = rows.filter((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("alert_id") > name)))
    return rows.orderBy("created_at", "alert_id").limit(size)


def conform(alerts: DataFrame) -> DataFrame:
    return alerts.select(*[F.col(f.name).cast(f.dataType) for f in ALERT_SCHEMA])
