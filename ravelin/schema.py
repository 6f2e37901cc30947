"""Event, alert, dead-letter and metric schemas, and the boundary that removes nulls from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enum names in numeric order.
SEVERITIES = [
    "SEVERITY_UNSPECIFIED",
    "SEVERITY_LOW",
    "SEVERITY_MEDIUM",
    "SEVERITY_HIGH",
    "SEVERITY_CRITICAL",
]
EVENT_TYPES = [
    "EVENT_TYPE_UNSPECIFIED",
    "EVENT_TYPE_AUTH_SUCCESS",
    "EVENT_TYPE_AUTH_FAILURE",
    "EVENT_TYPE_PROCESS_START",
    "EVENT_TYPE_PROCESS_STOP",
    "EVENT_TYPE_NETWORK_CONNECT",
    "EVENT_TYPE_NETWORK_LISTEN",
    "EVENT_TYPE_FILE_ACCESS",
    "EVENT_TYPE_FILE_MODIFY",
    "EVENT_TYPE_PRIVILEGE_ESCALATION",
    "EVENT_TYPE_SYSTEM_CALL",
]

STRING_MAP = T.MapType(T.StringType(), T.StringType())
STRINGS = T.ArrayType(T.StringType())

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("source_port", T.LongType()),
        T.StructField("destination_port", T.LongType()),
        T.StructField("user", T.StringType()),
        T.StructField("process", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("raw_message", T.StringType()),
        T.StructField("metadata", STRING_MAP),
        T.StructField("agent_id", T.StringType()),
        T.StructField("severity", T.StringType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("description", T.StringType()),
        T.StructField("group_values", STRING_MAP),
        T.StructField("event_count", T.LongType()),
        T.StructField("event_ids", STRINGS),
        T.StructField("tags", STRINGS),
        T.StructField("enrichment", STRING_MAP),
    ]
)

DEAD_LETTER_SCHEMA = T.StructType(
    [
        T.StructField("original_topic", T.StringType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("failed_at", T.TimestampType()),
        T.StructField("headers", STRING_MAP),
    ]
)

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("metric", T.StringType()),
        T.StructField("labels", STRING_MAP),
        T.StructField("value", T.DoubleType()),
    ]
)


def empty_map():
    return F.create_map().cast(STRING_MAP)


def _default(field: T.StructField):
    if field.name == "type":
        return F.lit(EVENT_TYPES[0])
    if field.name == "severity":
        return F.lit(SEVERITIES[0])
    if isinstance(field.dataType, T.LongType):
        return F.lit(0).cast("bigint")
    if isinstance(field.dataType, T.MapType):
        return empty_map()
    return F.lit("")


def normalise_events(df: DataFrame, ingest_ts: str = "ingest_ts") -> DataFrame:
    """Canonical event columns without nulls: absent text is '', absent number 0, absent enum value 0.

    A null timestamp takes the ``ingest_ts`` column when there is one; extra columns are kept.
    """
    columns = []
    for field in EVENT_SCHEMA:
        present = field.name in df.columns
        if field.name == "timestamp":
            value = F.col("timestamp").cast("timestamp") if present else F.lit(None).cast("timestamp")
            if ingest_ts in df.columns:
                value = F.coalesce(value, F.col(ingest_ts).cast("timestamp"))
        elif present:
            value = F.coalesce(F.col(field.name).cast(field.dataType), _default(field))
        else:
            value = _default(field)
        columns.append(value.alias(field.name))
    extra = [F.col(c) for c in df.columns if c not in EVENT_SCHEMA.names]
    return df.select(*columns, *extra)


def severity_rank(column):
    """0..4 for the five severity names (priority order); other text ranks lowest."""
    rank = F.lit(0)
    for position, name in enumerate(SEVERITIES):
        rank = F.when(column == name, position).otherwise(rank)
    return rank
