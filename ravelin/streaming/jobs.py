"""Streaming queries: ingest, rules, alert decisions and delivery."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ravelin.functions.durations import duration_micros
from ravelin.functions.names import free
from ravelin.functions.times import micros
from ravelin.operators import rules as R
from ravelin.operators import alerts as A
from ravelin.operators.alerts import notification_payload, suppression_key, to_alerts
from ravelin.operators.delivery import Channel, deliver, delivery_tasks
from ravelin.operators.enrich import Enricher
from ravelin.operators.evaluate import CARRIED, KEYS, NO_RULE, constants, match
from ravelin.operators.keyindex import KeyIndex
from ravelin.operators.persist import event_rows
from ravelin.plans.pipeline import Outcome, enriched_events, standard_enrichers
from ravelin.sources.decode import encode_json
from ravelin.streaming.processors import Fold, OrderedProcessor, sequence_fold, threshold_fold, window_fold

JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def delay_micros(delay: str) -> int:
    """The length of a watermark delay such as ``10 minutes``."""
    from pandas import Timedelta

    return int(Timedelta(delay).value // 1000)


def use_state_store(spark) -> None:
    """Timers and list state need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ordered(
    rows: DataFrame, keys: list[str], choose: Callable[[tuple], Fold], schema: T.StructType, keep_all: bool, delay: str
) -> DataFrame:
    """``rows`` has the keys and ``ts, id, steps, payload``, under a watermark."""
    use_state_store(rows.sparkSession)
    out = T.StructType(
        [rows.schema[k] for k in keys]
        + [
            T.StructField("ts", T.LongType()),
            T.StructField("id", T.StringType()),
            T.StructField("payload", T.StringType()),
            T.StructField("picked", T.BooleanType()),
        ]
    )
    processor = OrderedProcessor(choose, schema, keys, keep_all, delay_micros(delay))
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime")


def stream_first_per_window(
    df: DataFrame, keys: Sequence[Column], ts: str, tie: str, window: str, inclusive: bool, delay: str, flag: str = "kept"
) -> DataFrame:
    """All rows with ``flag``, emitted when the watermark passes them; a late row, or one without time, is judged
    when it comes. ``ts`` is a timestamp column."""
    fold = window_fold(duration_micros(window), inclusive)
    schema = df.schema
    rows = df.withWatermark(ts, delay).select(
        F.concat_ws("\u0001", *keys).alias("key"),
        F.coalesce(micros(F.col(ts)), F.lit(0)).alias("ts"),
        F.col(tie).cast("string").alias("id"),
        F.lit(0).cast("bigint").alias("steps"),
        F.to_json(F.struct(*df.columns), JSON_TIMES).alias("payload"),
    )
    out = _ordered(rows, ["key"], lambda _: fold, fold.schema, True, delay)
    back = F.from_json("payload", schema, JSON_TIMES)
    return out.select(back.alias("row"), F.col("picked").alias(flag)).select("row.*", flag)


def stream_ingest(df: DataFrame, ttl: str = "300s", delay: str = "10 minutes", arrival: str = "arrival_ts", tie: str = "event_id") -> DataFrame:
    """Events with ``reason``; the time to live runs on arrival time. Nameless events pass at once; a null id is an
    empty one."""
    named = df.filter("event_id <> ''")
    marked = stream_first_per_window(named, [F.col("event_id")], arrival, tie, ttl, False, delay)
    judged = marked.withColumn("reason", F.when(~F.col("kept"), "duplicate")).drop("kept")
    return judged.unionByName(df.filter("coalesce(event_id, '') = ''").withColumn("reason", F.lit("empty event_id")))


def stream_suppress(alerts: DataFrame, window: str = "300s", delay: str = "10 minutes") -> DataFrame:
    return stream_first_per_window(alerts, [suppression_key()], "created_at", "alert_id", window, True, delay)


def decide_batches(
    sink: Callable[[DataFrame, int], None],
    state_path: str,
    rate: float = 100.0,
    keys: Sequence[str] = (),
    interval_micros: int | None = None,
    capacity: int | None = None,
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over ``stream_suppress``: limit the rate and hand alerts with their ``decision`` to ``sink``.

    The buckets between two micro-batches are a small table, one folder per batch under ``state_path``; a repeated
    batch starts from the folder before its own and so decides alike. Inside a batch the buckets are those of the batch
    operator, whose runs of ticks are summed up in parallel, also for the one global bucket. A micro-batch holds what
    the watermark has passed since the one before, so decisions equal those over the whole table; a late alert counts
    as at the last tick its bucket saw.
    """
    interval, most = A.refill(rate, interval_micros, capacity)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()  # the source of the batch is folded once
        try:
            state, known = newest_before(spark, state_path, batch_id)
            kept = rows.filter("kept").drop("kept")
            (at,) = free(kept, "created_us")
            timed = kept.withColumn(at, F.coalesce(micros(F.col("created_at")), F.lit(0)))
            (allowed,) = free(timed, "allowed")
            limited, buckets = A.token_bucket_from(timed, state, at, "alert_id", interval, most, keys, allowed)
            decided = limited.withColumn("decision", F.when(F.col(allowed), A.SENT).otherwise(A.RATE_LIMITED)).drop(allowed, at)
            silenced = rows.filter("NOT kept").drop("kept").withColumn("decision", F.lit(A.SUPPRESSED))
            buckets.coalesce(8).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")
            sink(decided.unionByName(silenced), batch_id)
            for old in known[:-1]:  # the newest of them is needed if this batch is repeated
                remove_folder(spark, f"{state_path}/batch={old}")
        finally:
            rows.unpersist()

    return run


def stream_decide(
    alerts: DataFrame, sink: Callable[[DataFrame, int], None], state_path: str, window: str = "300s", delay: str = "10 minutes", **limits
) -> DataStreamWriter:
    """Suppress, then limit the rate, as ``decide`` does over a table; ``limits`` are those of ``decide_batches``."""
    return stream_suppress(alerts, window, delay).writeStream.foreachBatch(decide_batches(sink, state_path, **limits))


def newest_before(spark, path: str, batch_id: int) -> tuple[DataFrame | None, list[int]]:
    """The table the newest earlier batch has left, and the numbers of all earlier ones."""
    numbers = [n for n in batch_numbers(spark, path) if n < batch_id]
    return (spark.read.schema(A.BUCKET_STATE).parquet(f"{path}/batch={numbers[-1]}") if numbers else None), numbers


def batch_numbers(spark, path: str) -> list[int]:
    """Batches that have written a whole folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def remove_folder(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _rule_fold(rule: R.Rule) -> Fold:
    if rule.type == R.THRESHOLD:
        return threshold_fold(rule.window_micros, rule.threshold)
    return sequence_fold(rule.window_micros, [s.required for s in rule.steps])


def stream_evaluate(df: DataFrame, rules: Sequence[R.Rule], delay: str = "10 minutes") -> DataFrame:
    """All enabled rules over a stream of canonical events; the columns of the batch evaluation.

    Threshold and sequence rules share one stateful operator on ``(rule_ix, group_key)``; single rules need
    no state.
    """
    rules = R.check_distinct_ids(list(rules))
    live = [(i, r) for i, r in enumerate(rules) if r.enabled]
    singles = [(i, r) for i, r in live if r.type == R.SINGLE]
    stateful = {i: r for i, r in live if r.type != R.SINGLE}
    carried_schema = T.StructType([df.schema[c] for c in CARRIED])
    parts = []
    if singles or not stateful:
        parts.append(match(df, singles or [(0, NO_RULE)], CARRIED).drop("ts", "steps"))
    if stateful:
        marked = df.withWatermark("timestamp", delay)
        rows = match(marked, list(stateful.items()), CARRIED).select(
            *KEYS, "ts", F.col("event_id").alias("id"), "steps", F.to_json(F.struct(*CARRIED), JSON_TIMES).alias("payload")
        )
        folds = {i: _rule_fold(r) for i, r in stateful.items()}
        fields = {}
        for fold in folds.values():
            fields.update({f.name: f for f in fold.schema})
        width = T.StructType(list(fields.values()))
        padded = {i: _pad(fold, width) for i, fold in folds.items()}
        fired = _ordered(rows, KEYS, lambda key: padded[int(key[0])], width, False, delay)
        parts.append(
            fired.select(*KEYS, F.col("id").alias("event_id"), F.from_json("payload", carried_schema, JSON_TIMES).alias("c")).select(
                *KEYS, "event_id", *[F.col(f"c.{name}").alias(name) for name in CARRIED]
            )
        )
    results = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return constants(results, rules).select(
        "rule_ix", "rule.*", "group_key", "event_id", F.array("event_id").alias("event_ids"), *CARRIED
    )


def _pad(fold: Fold, width: T.StructType) -> Fold:
    """The same fold over a state row wide enough for every kind of rule."""
    places = [width.names.index(name) for name in fold.schema.names]
    blank = [None] * len(width)

    def widen(state):
        row = list(blank)
        for place, value in zip(places, state):
            row[place] = value
        return tuple(row)

    def narrow(row):
        return tuple(row[place] for place in places)

    def step(row, ts, steps, ring):
        state, picked = fold.step(narrow(row), ts, steps, ring)
        return widen(state), picked

    return Fold(width, widen(fold.initial), step, lambda row: fold.ends(narrow(row)))


def stream_alerts(df: DataFrame, rules: Sequence[R.Rule], delay: str = "10 minutes") -> DataFrame:
    return to_alerts(stream_evaluate(df, rules, delay))


def stream_pipeline(
    events: DataFrame, rules: Sequence[R.Rule], threats: DataFrame, enrichers: Sequence[Enricher] | None = None, delay: str = "10 minutes"
) -> Outcome:
    """The event path of the batch pipeline over a stream: enriched, classified events and the alerts they raise.
    ``threats`` is a static table; start one query for each of the two results."""
    steps = standard_enrichers(threats) if enrichers is None else list(enrichers)
    ready = enriched_events(events, steps)
    return Outcome(ready, stream_alerts(ready, rules, delay))


def persist_batches(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: insert-if-absent with the encoded event, so a repeated batch adds nothing and the stored
    table can be replayed. An index of the ids beside the table keeps the cost of a batch from growing with it."""
    return lambda batch, _: KeyIndex(batch.sparkSession, path).insert(event_rows(encode_json(batch, name="encoded"), "encoded"))


def deliver_batches(
    channels: Sequence[Channel], send: Callable[[str, str, dict, str], int], receipts_path: str, letters_path: str
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: send the alerts of a micro-batch; its receipts and dead letters are a folder each, which
    a repeated batch writes anew."""

    def run(batch: DataFrame, batch_id: int) -> None:
        done, letters = deliver(delivery_tasks(notification_payload(batch), channels), send)
        for frame, path in ((done, receipts_path), (letters, letters_path)):
            frame.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return run


def reloading_single_rules(rules_dir: str, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: read the rule folder again for each micro-batch and raise single-rule alerts.

    Threshold and sequence rules hold state; to change those, restart the query on its checkpoint.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        from ravelin.operators.evaluate import evaluate

        rules = [r for r in R.load_rules(rules_dir, batch.sparkSession) if r.type == R.SINGLE]
        sink(to_alerts(evaluate(batch, rules)), batch_id)

    return run
