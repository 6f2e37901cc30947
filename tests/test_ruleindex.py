"""The rule index against the compiled match, and what it costs."""

import random

import pytest
from pyspark.sql import functions as F

from ravelin.operators import evaluate as E
from ravelin.operators.ruleindex import RuleIndex, match_indexed, needle_pattern
from ravelin.operators.rules import Condition, Rule, Step
from ravelin.schema import normalise_events

WORDS = ["", "a", "ab", "abc", "b", "root", "user=1", "user=12", "x.y", "(z)", "é", "_q", "22"]
NAMES = ["type", "event_type", "hostname", "user", "service", "source_port", "raw_message", "meta.k", "k", "gone", "severity"]


def random_condition(rng):
    op = rng.choice(["eq", "eq", "contains", "contains", "neq", "regex", "exists", "odd"] if rng.random() < 0.7 else ["eq"])
    value = rng.choice(["^a", "b$", "(a", "r..t", r"\d+"]) if op == "regex" else rng.choice(WORDS)
    return Condition(rng.choice(NAMES), op, value)


def random_rules(rng, count):
    rules = []
    for i in range(count):
        conditions = tuple(random_condition(rng) for _ in range(rng.randrange(1, 4)))
        group_by = rng.choice([("hostname",), ("user", "service"), ("k",)])
        if i % 3 == 2:
            steps = tuple(Step(tuple(random_condition(rng) for _ in range(rng.randrange(0, 3))), rng.randrange(3)) for _ in range(3))
            rules.append(Rule(f"r{i}", "n", "sequence", steps=steps, group_by=group_by, window_micros=50))
        elif i % 3:
            rules.append(Rule(f"r{i}", "n", "threshold", conditions=conditions, group_by=group_by, threshold=rng.randrange(1, 4), window_micros=20))
        else:
            rules.append(Rule(f"r{i}", "n", "single", conditions=conditions, group_by=group_by))
    return rules


def random_events(spark, rng, count):
    def text():
        return rng.choice([None, *WORDS]) if rng.random() < 0.6 else "".join(rng.choice(WORDS) for _ in range(4))

    rows = [(f"e{i}" if i % 9 else None, text(), text(), text(), text(), rng.choice([None, 0, 22]), text(), {"k": text()} if i % 4 else None, i) for i in range(count)]
    raw = spark.createDataFrame(rows, "event_id string, type string, hostname string, user string, service string, source_port bigint, raw_message string, metadata map<string,string>, us bigint")
    return normalise_events(raw.withColumn("timestamp", F.timestamp_micros("us"))).withColumn("met", F.lit("mine")).withColumn("value_0", F.lit("own"))


@pytest.mark.parametrize("seed", [1, 2])
def test_index_equals_compiled_match(spark, seed):
    rng = random.Random(seed)
    rules, events = random_rules(rng, 90), random_events(spark, rng, 150)
    numbered = list(enumerate(rules))
    columns = ["rule_ix", "group_key", "steps", "ts", "event_id", "met", "value_0"]
    want = E.match(events, numbered, ["met", "value_0"], indexed_from=10**6).select(columns)
    got = E.match(events, numbered, ["met", "value_0"], indexed_from=0).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


def test_evaluate_with_and_without_index(spark, monkeypatch):
    rng = random.Random(5)
    rules, events = random_rules(rng, 80), random_events(spark, rng, 200)
    columns = ["rule_id", "severity", "group_key", "event_id", "event_count"]
    got = sorted(map(tuple, E.evaluate(events, rules, carried=()).select(columns).collect()))
    monkeypatch.setattr(E.match, "__defaults__", (10**6,))
    monkeypatch.setattr(E, "INDEXED_FROM", 10**6)
    assert got == sorted(map(tuple, E.evaluate(events, rules, carried=()).select(columns).collect())) and got


def test_needles_inside_each_other(spark):
    texts = spark.createDataFrame([("xabcabd",), ("ab",), ("",), ("a.b|c\\d\n$",)], "t string")
    needles = ["a", "ab", "abc", "bca", "d", "abd", ".b|", "\\d\n", "$"]
    found = texts.select("t", F.regexp_extract_all("t", F.lit(f"(?=({needle_pattern(needles)}))"), F.lit(1)).alias("f")).collect()
    for row in found:
        assert {n for n in needles if any(f.startswith(n) for f in row["f"])} == {n for n in needles if n in row["t"]}


def many(count):
    return [Rule(f"r{i}", "n", "single", conditions=(Condition("type", "eq", "EVENT_TYPE_AUTH_FAILURE"), Condition("user", "eq", f"u{i}")), group_by=("hostname",)) for i in range(count)]


def test_the_plan_does_not_grow_with_the_rules(spark):
    events = random_events(spark, random.Random(1), 10)

    def plan(count):
        return match_indexed(events, list(enumerate(many(count))))._jdf.queryExecution().executedPlan().toString()

    few, lots = plan(100), plan(2_000)
    assert few.count("BroadcastHashJoin") == lots.count("BroadcastHashJoin") == 2 and few.count("\n") == lots.count("\n")


def test_only_rules_that_are_met_are_tested(spark):
    index = RuleIndex(list(enumerate(many(2_000))))
    assert list(index.equal) == ["user"] and not index.always and all(len(v) == 1 for v in index.equal["user"].values())
    assert index.needed() is not None
    assert RuleIndex([(0, Rule("x", "x", "single", conditions=(Condition("user", "neq", "a"),)))]).always == {0}


def test_no_rule_can_match(spark):
    events = random_events(spark, random.Random(1), 10)
    assert match_indexed(events, [(0, Rule("x", "x", "single", conditions=(Condition("user", "odd", "a"),)))]).count() == 0
    assert match_indexed(events, []).count() == 0
