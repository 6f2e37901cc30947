"""Delivery of notifications as table jobs: tasks, attempts, receipts and dead letters."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ravelin.functions.signing import hmac_sha256
from ravelin.operators.alerts import DISPATCH_SUBJECT
from ravelin.schema import DEAD_LETTER_SCHEMA, empty_map
from ravelin.session import materialise

# Retry plan, outcome limit and texts of a delivery.
ATTEMPTS = 3
BASE_DELAY_MS = 500
MULTIPLIER = 2.0
MAX_DELAY_MS = 10_000
JITTER_LOW, JITTER_HIGH = 0.75, 1.25
FAILURE_STATUS = 300
RETRIES_SPENT = "max retry attempts reached"
DEAD_LETTER_CAP = 10_000
CONTENT_TYPE = "application/json"

SENT, FAILED, DLQ = "sent", "failed", "dlq"


@dataclass(frozen=True)
class Channel:
    name: str
    url: str = ""
    secret: str = ""


LOG_CHANNEL = Channel("log")


def delivery_tasks(alerts: DataFrame, channels: Sequence[Channel], header_prefix: str = "X-Alert") -> DataFrame:
    """One task per alert and channel, with the request headers. A narrow fan-out without a shuffle.

    The signature header is present when the channel has a secret.
    """
    body = F.col("payload")
    entries = []
    for channel in channels:
        headers = [F.lit("Content-Type"), F.lit(CONTENT_TYPE), F.lit(f"{header_prefix}-Event"), F.lit("alert")]
        if channel.secret:
            signature = F.concat(F.lit("sha256="), hmac_sha256(body, channel.secret))
            headers += [F.lit(f"{header_prefix}-Signature"), signature]
        entries.append(
            F.struct(
                F.lit(channel.name).alias("channel"),
                F.lit(channel.url).alias("url"),
                F.create_map(*headers).alias("headers"),
            )
        )
    return alerts.select("alert_id", "payload", F.inline(F.array(*entries)))


def payload_severity(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.severity"), F.lit("UNKNOWN"))


def payload_alert_id(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.alert_id"), F.lit(""))


def log_lines(alerts: DataFrame) -> DataFrame:
    """What the log channel writes; it always succeeds."""
    return alerts.select(
        payload_alert_id(F.col("payload")).alias("alert_id"),
        payload_severity(F.col("payload")).alias("severity"),
        "payload",
    )


def retry_delays(
    attempts: int = ATTEMPTS, base_ms: int = BASE_DELAY_MS, multiplier: float = MULTIPLIER, cap_ms: int = MAX_DELAY_MS
) -> list[int]:
    """Waits between attempts before jitter. The cap holds from the second wait on."""
    delays, delay = [], base_ms
    for _ in range(attempts - 1):
        delays.append(delay)
        delay = min(int(delay * multiplier), cap_ms)
    return delays


def retry_schedule(
    tasks: DataFrame,
    attempts: int = ATTEMPTS,
    base_ms: int = BASE_DELAY_MS,
    multiplier: float = MULTIPLIER,
    cap_ms: int = MAX_DELAY_MS,
) -> DataFrame:
    """One row per task and attempt: the wait before it, its jitter range and the planned offset."""
    waits = [0, *retry_delays(attempts, base_ms, multiplier, cap_ms)]
    planned = [
        F.struct(
            F.lit(number + 1).alias("attempt"),
            F.lit(wait).cast("bigint").alias("wait_ms"),
            F.lit(wait * JITTER_LOW).alias("wait_low_ms"),
            F.lit(wait * JITTER_HIGH).alias("wait_high_ms"),
            F.lit(sum(waits[: number + 1])).cast("bigint").alias("offset_ms"),
        )
        for number, wait in enumerate(waits)
    ]
    return tasks.select("alert_id", "channel", F.inline(F.array(*planned)))


def failure_text(status: Column) -> Column:
    """Null when an attempt succeeded."""
    return F.when(status >= FAILURE_STATUS, F.format_string("webhook returned status %d", status))


def receipts(tasks: DataFrame, tries: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Receipts from recorded attempts ``(alert_id, channel, attempt, status, attempted_at)``.

    The first success ends a task, so later recorded attempts do not count. A task without a url is sent
    without an attempt. ``failed`` still has attempts left, ``dlq`` has none.
    """
    error = failure_text(F.col("status"))
    folded = (
        tries.filter(F.col("attempt") <= attempts)
        .groupBy("alert_id", "channel")
        .agg(
            F.min(F.when(error.isNull(), F.struct("attempt", "attempted_at"))).alias("success"),
            F.max(F.struct("attempt", "attempted_at", error.alias("error"))).alias("last"),
        )
    )
    outcome = (
        F.when(F.col("url") == "", SENT)
        .when(F.col("success").isNotNull(), SENT)
        .when(F.col("last.attempt") >= attempts, DLQ)
        .otherwise(FAILED)
    )
    text = F.when(outcome == DLQ, F.concat(F.lit(f"{RETRIES_SPENT}: "), F.col("last.error"))).when(
        outcome == FAILED, F.col("last.error")
    )
    return tasks.join(folded, ["alert_id", "channel"], "left").select(
        "alert_id",
        "channel",
        outcome.alias("status"),
        F.coalesce("success.attempted_at", "last.attempted_at").alias("attempted_at"),
        F.coalesce(text, F.lit("")).alias("error"),
        F.coalesce("success.attempt", "last.attempt", F.lit(0)).alias("attempts"),
        "payload",
    )


def dead_letters(done: DataFrame, topic: str = DISPATCH_SUBJECT, failed_at: Column | None = None) -> DataFrame:
    """A dead letter per task that spent its attempts."""
    when = failed_at if failed_at is not None else F.coalesce(F.col("attempted_at"), F.current_timestamp())
    return done.filter(F.col("status") == DLQ).select(
        F.lit(topic).alias("original_topic"),
        F.lit(None).cast("binary").alias("key"),
        F.col("payload").cast("binary").alias("value"),
        F.format_string("channel %s: %s", "channel", "error").alias("error"),
        F.col("attempts").cast("int").alias("attempts"),
        when.alias("failed_at"),
        empty_map().alias("headers"),
    )


def format_error(topic: Column, error: Column, attempts: Column) -> Column:
    return F.format_string("topic=%s attempts=%d error=%s", topic, attempts, error)


def keep_newest(letters: DataFrame, cap: int = DEAD_LETTER_CAP, order: Sequence[str] | None = None) -> DataFrame:
    """The newest ``cap`` dead letters. A top-k: each task keeps at most ``cap`` rows before they meet. Unless an order
    is given, letters of one time go by their other columns, so the choice is always the same."""
    if order is None:
        plain = [f.name for f in letters.schema if not isinstance(f.dataType, MapType)]
        order = ["failed_at", *(c for c in plain if c != "failed_at")]
    return letters.orderBy(*[F.col(c).desc() for c in order]).limit(cap)


def drain(letters: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Dead letters that were not processed again yet."""
    return letters.join(done.select(*key), list(key), "left_anti")


def deliver(
    tasks: DataFrame,
    send: Callable[[str, str, dict, str], int],
    attempts: int = ATTEMPTS,
    base_ms: int = BASE_DELAY_MS,
    pause: Callable[[float], None] = time.sleep,
) -> tuple[DataFrame, DataFrame]:
    """Send each task and return ``(receipts, dead_letters)``.

    ``send(channel, url, headers, body)`` gives an HTTP status or raises. Sending happens once, here: the
    receipts are checkpointed. A lost executor repeats its tasks, so delivery is at least once.
    """
    delays = retry_delays(attempts, base_ms)

    def one(channel, url, headers, body):
        if not url:  # the log channel always succeeds, a channel that is not set up has nothing to do
            return SENT, "", 0
        problem = ""
        for number in range(1, attempts + 1):
            try:
                status = send(channel, url, headers, body)
                if status < FAILURE_STATUS:
                    return SENT, "", number
                problem = f"webhook returned status {status}"
            except Exception as error:  # noqa: BLE001 - a sender may raise anything
                problem = str(error)
            if number < attempts:
                pause(delays[number - 1] * random.uniform(JITTER_LOW, JITTER_HIGH) / 1000)
        return DLQ, f"{RETRIES_SPENT}: {problem}", attempts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [
                one(c, u, dict(h), p) for c, u, h, p in zip(frame.channel, frame.url, frame.headers, frame.payload)
            ]
            out = frame[["alert_id", "channel", "payload"]].copy()
            out["status"], out["error"], out["attempts"] = zip(*done) if done else ([], [], [])
            out["attempted_at"] = pd.Timestamp.now(tz="UTC")
            yield out

    shape = "alert_id string, channel string, payload string, status string, error string, attempts int, attempted_at timestamp"
    done = materialise(tasks.select("alert_id", "channel", "payload", "url", "headers").mapInPandas(run, shape))
    return done, dead_letters(done)


def conform_dead_letters(letters: DataFrame) -> DataFrame:
    return letters.select(*[F.col(f.name).cast(f.dataType) for f in DEAD_LETTER_SCHEMA])
