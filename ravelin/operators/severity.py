"""Event severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def severity_column() -> Column:
    threat = F.coalesce(F.col("metadata")["threat_known"] == "true", F.lit(False))
    kind = F.col("type")
    return (
        F.when((kind == "EVENT_TYPE_PRIVILEGE_ESCALATION") & threat, "SEVERITY_CRITICAL")
        .when(kind == "EVENT_TYPE_PRIVILEGE_ESCALATION", "SEVERITY_HIGH")
        .when((kind == "EVENT_TYPE_AUTH_FAILURE") & threat, "SEVERITY_HIGH")
        .when(kind.isin("EVENT_TYPE_AUTH_FAILURE", "EVENT_TYPE_FILE_MODIFY"), "SEVERITY_MEDIUM")
        .otherwise("SEVERITY_LOW")
    )


def classify_severity(df: DataFrame) -> DataFrame:
    """Overwrites whatever severity the producer set."""
    return df.withColumn("severity", severity_column())
