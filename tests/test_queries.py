"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from checks import queries as checked
from checks.compare import rows_of

QUERIES, ORACLES = checked.QUERIES, checked.ORACLES


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, database, name):
    frame = QUERIES[name](spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = database.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_expected_fires(spark, sf_dir):
    counts = {name: QUERIES[name](spark, sf_dir).count() for name in ("threshold_3_in_3_days", "threshold_3_in_1_day", "sequence_3_days", "sequence_5_days")}
    assert list(counts.values()) == [40, 12, 15, 29]
