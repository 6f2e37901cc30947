"""Log lines to events, all native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.schema import normalise_events

# Phrases that classify a line, and the word before an address.
FAILURE_PHRASES = ["failed password", "authentication failure"]
SUCCESS_PHRASES = ["accepted password", "session opened"]
ESCALATION_WORDS = ["sudo", "root"]
SUDO_SERVICE = "sudo"
SOURCE_MARK = "from "
SERVICE_FIELD = 5


def _has(line: Column, words: list[str], every: bool) -> Column:
    found = [F.lower(line).contains(word) for word in words]
    out = found[0]
    for test in found[1:]:
        out = (out & test) if every else (out | test)
    return out


def line_type(line: Column) -> Column:
    """The first class that matches wins, so a sudo line with an opened session is a success."""
    return (
        F.when(_has(line, FAILURE_PHRASES, False), "EVENT_TYPE_AUTH_FAILURE")
        .when(_has(line, SUCCESS_PHRASES, False), "EVENT_TYPE_AUTH_SUCCESS")
        .when(_has(line, ESCALATION_WORDS, True), "EVENT_TYPE_PRIVILEGE_ESCALATION")
        .otherwise("EVENT_TYPE_SYSTEM_CALL")
    )


def service_field(line: Column) -> Column:
    """Field five without its ``[pid]`` or one trailing colon."""
    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    word = F.coalesce(F.try_element_at(words, F.lit(SERVICE_FIELD)), F.lit(""))
    return F.when(word.contains("["), F.substring_index(word, "[", 1)).otherwise(F.regexp_replace(word, r":\z", ""))


def line_service(line: Column) -> Column:
    kind = line_type(line)
    return (
        F.when(kind.isin("EVENT_TYPE_AUTH_FAILURE", "EVENT_TYPE_AUTH_SUCCESS"), service_field(line))
        .when(kind == "EVENT_TYPE_PRIVILEGE_ESCALATION", SUDO_SERVICE)
        .otherwise("")
    )


def line_source_ip(line: Column) -> Column:
    """The word after the first ``from``, in any case; it is not checked."""
    return F.regexp_extract(line, rf"(?is)\A.*?{SOURCE_MARK}([^ ]*)", 1)


def parse_log_lines(
    df: DataFrame, path: str = "path", line: str = "line", agent_id: str = "", hostname: Column | None = None,
    timestamp: Column | None = None, offset: str | None = None,
) -> DataFrame:
    """Events from non-empty lines. The id is a hash of file, offset (when given) and line, so reading a
    file again gives the same ids."""
    text = F.col(line)
    identity = [F.col(path), F.col(offset).cast("string") if offset else F.lit(""), text]
    rows = df.filter(text != "").select(
        F.sha2(F.concat_ws("\u0001", *identity), 256).alias("event_id"),
        line_type(text).alias("type"),
        (timestamp if timestamp is not None else F.current_timestamp()).alias("timestamp"),
        (hostname if hostname is not None else F.lit("")).alias("hostname"),
        line_source_ip(text).alias("source_ip"),
        line_service(text).alias("service"),
        text.alias("raw_message"),
        F.create_map(F.lit("source_file"), F.col(path)).alias("metadata"),
        F.lit(agent_id).alias("agent_id"),
    )
    return normalise_events(rows)
