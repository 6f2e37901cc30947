"""Rule conditions as columns over the canonical event schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions.patterns import java_pattern

# Names that read an event column; every other name reads the metadata map.
EVENT_FIELDS = [
    "type",
    "event_type",
    "hostname",
    "source_ip",
    "destination_ip",
    "source_port",
    "user",
    "process",
    "service",
    "severity",
    "agent_id",
    "raw_message",
]
METADATA_PREFIX = "meta."
GROUP_SEPARATOR = "|"


def field(name: str) -> Column:
    """The text of a rule field; anything missing is the empty text, never null."""
    if name == "source_port":
        return F.when(F.col("source_port") > 0, F.col("source_port").cast("string")).otherwise(F.lit(""))
    if name in EVENT_FIELDS:
        return F.coalesce(F.col("type" if name == "event_type" else name), F.lit(""))
    return F.coalesce(F.col("metadata")[name.removeprefix(METADATA_PREFIX)], F.lit(""))


def condition_column(name: str, op: str, value: str) -> Column:
    text = field(name)
    if op == "eq":
        return text == value
    if op == "neq":
        return text != value
    if op == "contains":
        return text.contains(value)
    if op == "regex":
        pattern = java_pattern(value)
        return F.lit(False) if pattern is None else text.rlike(pattern)
    if op == "exists":
        return text != ""
    return F.lit(False)


def conditions_column(conditions: Sequence) -> Column:
    """All conditions hold; an empty list matches nothing."""
    if not conditions:
        return F.lit(False)
    return reduce(Column.__and__, [condition_column(c.field, c.op, c.value) for c in conditions])


def group_key(fields: Sequence[str]) -> Column:
    """Field values joined with a pipe, not escaped; no fields give the empty text."""
    if not fields:
        return F.lit("")
    return F.concat_ws(GROUP_SEPARATOR, *[field(name) for name in fields])
