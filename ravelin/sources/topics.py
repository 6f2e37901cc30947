"""Topics: records ``(key, value)`` for Kafka or any sink with keyed records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_EVENTS, ALERTS = "raw-events", "alerts"


def kafka_options(brokers: list[str], topic: str, max_offsets: int | None = None) -> dict[str, str]:
    """A new reader starts at the earliest offset; progress lives in the checkpoint."""
    options = {
        "kafka.bootstrap.servers": ",".join(brokers),
        "subscribe": topic,
        "startingOffsets": "earliest",
    }
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def replay_options(brokers: list[str], topic: str, start: datetime, end: datetime) -> dict[str, str]:
    """A bounded read by record time. The end is exclusive in Kafka, so it lies one millisecond later;
    the replay filter itself is exact."""
    return {
        "kafka.bootstrap.servers": ",".join(brokers),
        "subscribe": topic,
        "startingTimestamp": str(int(start.timestamp() * 1000)),
        "endingTimestamp": str(int(end.timestamp() * 1000) + 1),
        "startingOffsetsByTimestampStrategy": "latest",
    }


def read_topic(spark: SparkSession, brokers: list[str], topic: str, max_offsets: int | None = None) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(brokers, topic, max_offsets)).load()


def read_topic_range(spark: SparkSession, brokers: list[str], topic: str, start: datetime, end: datetime) -> DataFrame:
    return spark.read.format("kafka").options(**replay_options(brokers, topic, start, end)).load()


def event_records(events: DataFrame, value: str = "value", topic: str = RAW_EVENTS) -> DataFrame:
    """Events keyed by hostname, so a host stays in one topic partition; :func:`ordered_per_host` orders them."""
    return events.select(F.lit(topic).alias("topic"), F.col("hostname").cast("binary").alias("key"), F.col(value).cast("binary").alias("value"))


def alert_records(alerts: DataFrame, value: str = "value", topic: str = ALERTS) -> DataFrame:
    """Alerts keyed by rule id."""
    return alerts.select(F.lit(topic).alias("topic"), F.col("rule_id").cast("binary").alias("key"), F.col(value).cast("binary").alias("value"))


def write_topic(records: DataFrame, brokers: list[str]) -> None:
    records.write.format("kafka").option("kafka.bootstrap.servers", ",".join(brokers)).save()


def ordered_per_host(events: DataFrame) -> DataFrame:
    """Events in time order per host: a host is written by one task, row after row. That is the price of an order
    that holds for the whole topic; where it must not be paid, write ``event_records`` as they are.
    """
    return events.repartition("hostname").sortWithinPartitions("hostname", "timestamp", "event_id")
