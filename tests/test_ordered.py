import random

import pytest
from pyspark.sql import functions as F

from ravelin.operators.evaluate import evaluate
from ravelin.operators.ordered import first_per_window
from ravelin.operators.rules import Condition, Rule, Step
from ravelin.schema import normalise_events
from tests import brute

KINDS = ["EVENT_TYPE_AUTH_FAILURE", "EVENT_TYPE_AUTH_SUCCESS", "EVENT_TYPE_PRIVILEGE_ESCALATION", "EVENT_TYPE_FILE_MODIFY"]
# (hot_rows, chunk_rows): no split, one level of chunks, several levels.
LIMITS = [(None, 100), (60, 20), (30, 6)]


def is_kind(*kinds):
    if len(kinds) == 1:
        return (Condition("type", "eq", KINDS[kinds[0]]),)
    return (Condition("type", "regex", "^(" + "|".join(KINDS[k] for k in kinds) + ")$"),)


def random_rows(seed, n=300, hot=0.6, keys=12, span=1200, periodic=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(keys)}"
        ts = (i * 7 if periodic else rng.randrange(span)) * 1_000_000
        rows.append((key, ts, f"e{i:05d}", rng.randrange(4)))
    return rows


def events(spark, rows):
    raw = spark.createDataFrame(rows, "source_ip string, us bigint, event_id string, kind int")
    names = F.array(*[F.lit(k) for k in KINDS])
    return normalise_events(
        raw.select("event_id", "source_ip", F.timestamp_micros("us").alias("timestamp"), names[F.col("kind")].alias("type"))
    )


def marked(spark, rows, window, inclusive, hot_rows, chunk):
    df = spark.createDataFrame(rows, "k string, ts bigint, id string, kind int")
    out = first_per_window(df, ["k"], "ts", ["id"], window * 1_000_000, inclusive, "kept", hot_rows, chunk).cache()
    assert out.count() == len(rows)
    got = sorted(r.id for r in out.filter("kept").collect())
    assert got == brute.first_per_window([r[:3] for r in rows], window * 1_000_000, inclusive)


@pytest.mark.parametrize("hot_rows,chunk", LIMITS)
def test_first_per_window(spark, hot_rows, chunk):
    marked(spark, random_rows(1), 20, True, hot_rows, chunk)
    marked(spark, random_rows(3, periodic=True), 35, False, hot_rows, chunk)


def test_a_window_wider_than_any_chunk_is_solved_in_rounds(spark):
    marked(spark, random_rows(4), 700, True, 15, 40)
    marked(spark, random_rows(4), 5000, False, 15, 40)


@pytest.mark.parametrize("hot_rows,chunk", LIMITS)
def test_rules_match_a_plain_loop(spark, hot_rows, chunk):
    for seed, window, periodic in [(1, 30, False)] if hot_rows == 30 else [(1, 30, False), (3, 49, True)]:
        rows = random_rows(seed, periodic=periodic)
        us = window * 1_000_000
        steps = [((0,), 2), ((0, 1), 1), ((2,), 1)]
        rules = [
            Rule("t1", "t1", "threshold", conditions=is_kind(0), group_by=("source_ip",), threshold=1, window_micros=us),
            Rule("t3", "t3", "threshold", conditions=is_kind(0, 1), group_by=("source_ip",), threshold=3, window_micros=us),
            Rule("t7", "t7", "threshold", conditions=is_kind(0, 1, 2), group_by=("source_ip",), threshold=7, window_micros=us),
            Rule("seq", "seq", "sequence", group_by=("source_ip",), window_micros=us,
                 steps=tuple(Step(is_kind(*k), c) for k, c in steps)),
            Rule("one", "one", "single", conditions=is_kind(3)),
            Rule("off", "off", "single", conditions=is_kind(3), enabled=False),
        ]
        out = evaluate(events(spark, rows), rules, hot_rows=hot_rows, chunk_rows=chunk).collect()
        got = {name: sorted(r.event_id for r in out if r.rule_id == name) for name in [r.id for r in rules]}

        def pick(*kinds):
            return [r[:3] for r in rows if r[3] in kinds]

        assert got["t1"] == brute.threshold(pick(0), us, 1)
        assert got["t3"] == brute.threshold(pick(0, 1), us, 3)
        assert got["t7"] == brute.threshold(pick(0, 1, 2), us, 7)
        assert got["seq"] == brute.sequence(rows, us, steps)
        assert got["one"] == sorted(r[2] for r in rows if r[3] == 3)
        assert got["off"] == []


def test_ordered_passes_sit_on_windows(spark):
    """A bare repartition below the pass could be merged into a join that is later read map by map."""
    df = spark.createDataFrame(random_rows(2, n=120), "k string, ts bigint, id string, kind int")
    out = first_per_window(df, ["k"], "ts", ["id"], 20_000_000, True, "kept", 30, 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count("row_number()") == 3
    assert "REPARTITION_BY_COL" not in plan
