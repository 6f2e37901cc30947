"""The whole event path: enrich, classify, evaluate, alert, persist."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.alerts import to_alerts
from ravelin.operators.enrich import Enricher, enrich, geo_enrich, threat_enrich
from ravelin.operators.evaluate import evaluate
from ravelin.operators.ordered import HOT_ROWS
from ravelin.operators.rules import Rule
from ravelin.operators.severity import classify_severity


@dataclass(frozen=True)
class Outcome:
    events: DataFrame
    alerts: DataFrame


def standard_enrichers(threats: DataFrame) -> list[Enricher]:
    return [geo_enrich, lambda df: threat_enrich(df, threats)]


def enriched_events(events: DataFrame, enrichers: Sequence[Enricher]) -> DataFrame:
    return classify_severity(enrich(events, enrichers))


def run_pipeline(
    events: DataFrame,
    rules: Sequence[Rule],
    threats: DataFrame,
    enrichers: Sequence[Enricher] | None = None,
    dedup: bool = True,
    hot_rows: int | None = HOT_ROWS,
) -> Outcome:
    """Enriched events and the alerts they raise.

    With ``dedup`` a redelivered event counts once in the rules, as it does in the stored table, which
    drops repeats when they are inserted. The plan is lazy but for the hot-key check; columns no rule
    needs are pruned from the alert branch.
    """
    steps = standard_enrichers(threats) if enrichers is None else list(enrichers)
    ready = enriched_events(events, steps)
    return Outcome(ready, to_alerts(evaluate(ready, rules, hot_rows=hot_rows, dedup=dedup)))


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("rule_id", "severity").agg(
        F.count(F.lit(1)).alias("alerts"), F.sum("event_count").alias("events")
    )
