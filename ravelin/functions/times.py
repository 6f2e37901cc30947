"""Timestamp helpers that do not depend on the session time zone."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(column: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP column."""
    return F.unix_micros(column)


def ntz_micros(name: str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ column read as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")


def rfc3339(column: Column) -> Column:
    """``2024-01-02T03:04:05Z``, cut to the second; null reads as the epoch."""
    seconds = F.coalesce(F.unix_seconds(column), F.lit(0))
    wall = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def parse_rfc3339(text: str) -> datetime:
    """Instant of an RFC3339 text; a missing zone is an error."""
    value = datetime.fromisoformat(text.replace("Z", "+00:00").replace("z", "+00:00"))
    if value.tzinfo is None or "T" not in text.upper():
        raise ValueError(f"invalid RFC3339 time {text!r}")
    return value.astimezone(timezone.utc)


def instant(value: datetime) -> Column:
    """A literal TIMESTAMP for an aware datetime."""
    whole = value.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(whole.days * 86_400_000_000 + whole.seconds * 1_000_000 + whole.microseconds))
