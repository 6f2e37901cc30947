"""File sources and sinks, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).filter("line <> ''")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line)`` of all non-empty lines."""
    return _lines(spark.read.text(path))


def tail_log_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as a stream of ``(path, line)``; the checkpoint remembers what was read."""
    return _lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Alerts in one folder per rule."""
    alerts.write.mode("append").partitionBy("rule_id").parquet(path)
