"""Run every query next to its SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from checks.queries import ORACLES, QUERIES
from ravelin.session import local_session


def normal(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=repr)


def main(sf_dir: str, names: list[str]) -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    database = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        database.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    bad = 0
    for name in names or list(QUERIES):
        begun = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
            spent = time.time() - begun
            if name not in ORACLES:
                print(f"{name}: {len(got)} rows, no SQL, {spent:.1f}s", flush=True)
                continue
            result = database.execute(ORACLES[name])
            columns = [d[0] for d in result.description]
            want = rows_of(columns, result.fetchall())
            same = got == want and sorted(columns) == sorted(frame.columns)
            print(f"{name}: {'same' if same else 'DIFFERENT'} {len(got)}/{len(want)} rows, {spent:.1f}s, sql {time.time() - begun - spent:.1f}s", flush=True)
            if not same:
                bad += 1
                print("  columns", sorted(frame.columns), sorted(columns))
                print("  only spark", [r for r in got if r not in set(want)][:3])
                print("  only sql  ", [r for r in want if r not in set(got)][:3])
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"{name}: ERROR {str(error)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
