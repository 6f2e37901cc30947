"""Replay: the same rules over a historical range, on fresh state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions.times import parse_rfc3339
from ravelin.operators.enrich import Enricher
from ravelin.operators.evaluate import evaluate
from ravelin.operators.ordered import HOT_ROWS
from ravelin.operators.persist import in_time_range
from ravelin.operators.rules import Rule
from ravelin.plans.pipeline import enriched_events


@dataclass(frozen=True)
class Replay:
    matches: DataFrame
    totals: DataFrame


def replay(
    events: DataFrame,
    start: str,
    end: str,
    rules: Sequence[Rule],
    enrichers: Sequence[Enricher] | None = None,
    record_time: str = "timestamp",
    hot_rows: int | None = HOT_ROWS,
) -> Replay:
    """Matches and totals of ``[start, end]`` (RFC3339, both inclusive) by record time.

    Without ``enrichers`` the events go to the rules as they are, so rules on enrichment keys do not
    fire. A match carries the rule's own severity text and the record time.
    """
    if not start or not end:
        raise ValueError("start and end are required")
    ranged = in_time_range(events, parse_rfc3339(start), parse_rfc3339(end), record_time)
    ready = ranged if enrichers is None else enriched_events(ranged, enrichers)
    carried = tuple(dict.fromkeys(["timestamp", "metadata", record_time]))
    fired = evaluate(ready, rules, carried, hot_rows)
    matches = fired.select(
        "rule_id",
        "rule_name",
        F.col("rule_severity").alias("severity"),
        "group_key",
        "event_count",
        F.col(record_time).alias("record_time"),
        "event_id",
    )
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    marks = ranged.select(one.alias("event"), zero.alias("match")).unionByName(
        matches.select(zero.alias("event"), one.alias("match"))
    )
    totals = marks.agg(
        F.coalesce(F.sum("event"), zero).alias("total_events"), F.coalesce(F.sum("match"), zero).alias("total_matches")
    )
    return Replay(matches, totals)
