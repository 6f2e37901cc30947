"""The events table: insert if absent, and the forensic access paths."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ravelin.functions.names import free
from ravelin.functions.times import instant

CURVE_BITS = 8  # of each column's hash
FILTERED = ["source_ip", "hostname"]
FILTER_VALUES = 65_536  # distinct values a file's filter is made for
ROW_GROUP_BYTES = 32 << 20

TABLE_COLUMNS = [
    "event_id", "event_type", "severity", "hostname", "source_ip", "destination_ip", "service", "timestamp", "raw_data",
]


def event_rows(df: DataFrame, raw: str | None = None) -> DataFrame:
    """Events in the shape of the stored table; ``raw`` names the column with the encoded event."""
    return df.select(
        "event_id",
        F.col("type").alias("event_type"),
        "severity",
        "hostname",
        "source_ip",
        "destination_ip",
        "service",
        "timestamp",
        (F.col(raw) if raw else F.lit(None).cast("binary")).alias("raw_data"),
    )


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key; ties go by a hash of the row. The minimum combines before the shuffle, so many copies
    of one key are cheap."""
    rest = [c for c in df.columns if c != key]
    plain = [c for c in rest if not isinstance(df.schema[c].dataType, MapType)]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order, F.xxhash64(*plain))).alias("row")).select(key, "row.*").select(*df.columns)


def absent_rows(incoming: DataFrame, stored: DataFrame, key: str = "event_id", order: str = "timestamp") -> DataFrame:
    """Rows an insert-if-absent would add."""
    return first_by(incoming, key, order).join(stored.select(key), key, "left_anti")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def insert_if_absent(rows: DataFrame, path: str, key: str = "event_id", created_at=None) -> None:
    """Append the rows whose key is not in the table at ``path``, partitioned by date.

    A repeated micro-batch adds nothing. One writer at a time: Parquet has no transactions. Every call reads the ids
    of the whole table; ``keyindex.KeyIndex`` reads only those a batch can meet.
    """
    stored = read_table(rows.sparkSession, path)
    append_rows(first_by(rows, key, "timestamp") if stored is None else absent_rows(rows, stored, key), path, created_at)


def append_rows(fresh: DataFrame, path: str, created_at=None) -> None:
    """Rows into the folder of their date, along a curve that interleaves hashes of source and host, then in time. Files
    are cut by ranges of that order and the row's own hash, so no task is bound to one pair of source and host, and each
    holds a small share of the sources and of the hosts. Filters in the files tell which: a query by either skips the
    others."""
    stamped = fresh.withColumn("created_at", created_at if created_at is not None else F.current_timestamp())
    dated = stamped.withColumn("date", F.to_date("timestamp"))
    curve, spread = free(dated, "curve", "spread")
    placed = dated.withColumn(curve, interleaved("source_ip", "hostname")).withColumn(spread, F.xxhash64("event_id" if "event_id" in dated.columns else curve))
    ranged = placed.repartitionByRange("date", curve, spread).sortWithinPartitions("date", curve, "timestamp").drop(curve, spread)
    writer = ranged.write.mode("append").partitionBy("date").option("parquet.block.size", ROW_GROUP_BYTES)
    for column in FILTERED:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", FILTER_VALUES)
    writer.parquet(path)


def interleaved(*columns: str) -> Column:
    """The bits of the columns' hashes in turn, as one number: neighbours on it agree in the first bits of each."""
    hashes = [F.xxhash64(c) for c in columns]
    bits = [F.shiftright(h, 63 - i).bitwiseAND(1) for i in range(CURVE_BITS) for h in hashes]
    return reduce(lambda number, bit: number * 2 + bit, bits)


def in_time_range(events: DataFrame, start: datetime, end: datetime, column: str = "timestamp") -> DataFrame:
    """Both ends inclusive. On a table with a ``date`` column whole folders are pruned as well."""
    low, high = instant(start), instant(end)
    rows = events.filter(F.col(column).between(low, high))
    if "date" in events.columns and column == "timestamp":
        rows = rows.filter(F.col("date").between(F.to_date(low), F.to_date(high)))
    return rows


def from_source(events: DataFrame, source_ip: str) -> DataFrame:
    return events.filter(F.col("source_ip") == source_ip)


def on_host(events: DataFrame, hostname: str) -> DataFrame:
    return events.filter(F.col("hostname") == hostname)
