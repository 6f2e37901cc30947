import re

import pytest
from pyspark.sql import functions as F

from checks.queries import RULES_DIR
from ravelin.functions.durations import duration_micros, duration_nanos
from ravelin.functions.patterns import java_pattern
from ravelin.operators.conditions import condition_column, conditions_column, field, group_key
from ravelin.operators.evaluate import evaluate
from ravelin.operators.rules import Condition, Rule, check_distinct_ids, load_rules, parse_rule
from ravelin.schema import normalise_events

SINGLE = """
id: r1
name: First
type: single
conditions: [{field: type, op: eq, value: EVENT_TYPE_AUTH_FAILURE}]
severity: HIGH
tags: [a, b]
"""
THRESHOLD = """
id: r2
name: Second
type: threshold
conditions: [{field: source_port, op: eq, value: 22}]
group_by: [source_ip]
threshold: 5
window: 1m30s
"""
SEQUENCE = """
id: r3
name: Third
type: sequence
group_by: [user]
window: 10m
steps:
  - conditions: [{field: type, op: eq, value: A}]
    count: 3
  - conditions: []
"""


def test_parse_single_and_defaults():
    rule = parse_rule(SINGLE)
    assert (rule.id, rule.enabled, rule.severity_name, rule.tags) == ("r1", True, "SEVERITY_HIGH", ("a", "b"))


def test_parse_threshold_keeps_scalars_as_text():
    rule = parse_rule(THRESHOLD)
    assert rule.conditions[0].value == "22"
    assert (rule.threshold, rule.window_micros, rule.severity_name) == (5, 90_000_000, "SEVERITY_MEDIUM")


def test_parse_sequence_steps_are_not_validated():
    rule = parse_rule(SEQUENCE)
    assert [s.required for s in rule.steps] == [3, 1]


@pytest.mark.parametrize(
    "text",
    [
        SINGLE.replace("id: r1", ""),
        SINGLE.replace("name: First", ""),
        SINGLE.replace("type: single", "type: other"),
        SINGLE.replace("conditions: [{field: type, op: eq, value: EVENT_TYPE_AUTH_FAILURE}]", ""),
        THRESHOLD.replace("threshold: 5", ""),
        THRESHOLD.replace("window: 1m30s", ""),
        THRESHOLD.replace("window: 1m30s", "window: soon"),
        THRESHOLD.replace("group_by: [source_ip]", ""),
        SEQUENCE.replace("  - conditions: []\n", ""),
        SEQUENCE.replace("group_by: [user]", ""),
        "just text",
    ],
)
def test_invalid_rules_are_refused(text):
    with pytest.raises(ValueError):
        parse_rule(text)


def test_severity_text():
    names = {s: parse_rule(SINGLE.replace("HIGH", s)).severity_name for s in ("CRITICAL", "LOW", "low", "urgent")}
    assert names == {"CRITICAL": "SEVERITY_CRITICAL", "LOW": "SEVERITY_LOW", "low": "SEVERITY_MEDIUM", "urgent": "SEVERITY_MEDIUM"}


def test_load_rules_from_folder(spark, tmp_path):
    names = ["error-burst", "error-burst-sshd", "kill-chain", "listed-login", "quiet", "root-shell"]
    assert [r.id for r in load_rules(RULES_DIR)] == names
    assert [r.id for r in load_rules(RULES_DIR, spark)] == names
    (tmp_path / "a.yaml").write_text(SINGLE)
    (tmp_path / "b.txt").write_text("not a rule")
    assert [r.id for r in load_rules(str(tmp_path))] == ["r1"]
    (tmp_path / "b.yml").write_text(SINGLE)
    with pytest.raises(ValueError, match="duplicate"):
        load_rules(str(tmp_path))
    (tmp_path / "c.yml").write_text("id: x")
    with pytest.raises(ValueError, match="c.yml"):
        load_rules(str(tmp_path))
    with pytest.raises(ValueError):
        check_distinct_ids([parse_rule(SINGLE)] * 2)


def test_durations():
    texts = ["60s", "10m", "1h30m", "1.5h", "300ms", "2us", "1500", "0"]
    assert [duration_micros(t) for t in texts] == [60_000_000, 600_000_000, 5_400_000_000, 5_400_000_000, 300_000, 2, 1, 0]
    assert duration_nanos("-1s") == -1_000_000_000
    for bad in ("", "s", "5", "1d", "1 s"):
        if bad != "5":
            with pytest.raises(ValueError):
                duration_nanos(bad)


def test_patterns():
    rejected = ["a(?=b)", "(?<!a)b", r"(a)\1", "a[", "(", "a**", "a*+", "*a", "a{2,1}", "a{1001}", "(?>a)", "|*", "\\"]
    assert [p for p in rejected if java_pattern(p) is not None] == []
    assert java_pattern("a$") == r"(?d)a\z"
    assert java_pattern("(?P<n_1>x)") == "(?d)(x)"
    for fine in ["^a.b$", "(?i)x|y", "[[:alpha:]]+", r"\d{2,3}?", r"\pL", r"\Qa.b\E", "a{,5}", "(?:a)+", "[]a]", r"\p{Greek}"]:
        assert java_pattern(fine) is not None, fine


def events(spark, *rows):
    columns = "event_id string, type string, hostname string, source_ip string, source_port bigint, service string, raw_message string, metadata map<string,string>"
    return normalise_events(spark.createDataFrame(list(rows), columns))


def test_conditions_on_missing_values(spark):
    df = events(spark, ("e1", None, None, None, None, "sshd", "Failed password for root from 1.2.3.4\n", {"threat_category": "tor_exit"}))
    tests = {
        "eq": (condition_column("type", "eq", "EVENT_TYPE_UNSPECIFIED"), True),
        "sev": (condition_column("severity", "eq", "SEVERITY_UNSPECIFIED"), True),
        "neq_missing": (condition_column("user", "neq", "root"), True),
        "port": (condition_column("source_port", "exists", ""), False),
        "meta": (condition_column("meta.threat_category", "eq", "tor_exit"), True),
        "plain_meta": (condition_column("threat_category", "contains", "tor"), True),
        "not_a_field": (condition_column("event_id", "eq", "e1"), False),
        "end_of_text": (condition_column("raw_message", "regex", "4$"), False),
        "dot_newline": (condition_column("raw_message", "regex", "4.$"), False),
        "posix": (condition_column("service", "regex", "^[[:lower:]]{4}$"), True),
        "quoted": (condition_column("raw_message", "regex", r"\Q1.2.3\E"), True),
        "script": (condition_column("service", "regex", r"\p{Latin}"), True),
        "unknown": (condition_column("service", "is", "sshd"), False),
        "empty": (conditions_column([]), False),
    }
    row = df.select(*[c.alias(n) for n, (c, _) in tests.items()]).head()
    assert row.asDict() == {n: want for n, (_, want) in tests.items()}


def test_group_key(spark):
    df = events(spark, ("e1", None, None, "1.2.3.4", 22, "sshd", "", None))
    row = df.select(group_key(["source_ip", "service"]).alias("a"), group_key(["source_port", "gone"]).alias("b"), group_key([]).alias("c")).head()
    assert tuple(row) == ("1.2.3.4|sshd", "22|", "")
    assert df.select(field("event_type").alias("t")).head().t == "EVENT_TYPE_UNSPECIFIED"


def test_no_rules_give_no_results(spark):
    df = events(spark, ("e1", None, None, "1.2.3.4", 22, "sshd", "", None))
    off = Rule("x", "x", "single", enabled=False, conditions=(Condition("service", "exists", ""),))
    assert evaluate(df, []).count() == 0
    assert evaluate(df, [off]).count() == 0


def test_many_rules_are_split_into_projections(spark):
    df = events(spark, ("e1", None, None, "1.2.3.4", 22, "sshd", "", None))
    rules = [Rule(f"r{i}", "n", "single", conditions=(Condition("source_port", "eq", str(i)),)) for i in range(250)]
    assert [r.rule_id for r in evaluate(df, rules).select("rule_id").collect()] == ["r22"]


def test_stateful_rules_share_one_exchange(spark):
    df = events(spark, ("e1", None, None, "1.2.3.4", 22, "sshd", "", None)).withColumn("timestamp", F.timestamp_seconds("source_port"))
    rules = [parse_rule(THRESHOLD), parse_rule(SEQUENCE), parse_rule(THRESHOLD.replace("r2", "r4").replace("threshold: 5", "threshold: 9"))]
    plan = evaluate(df, rules, hot_rows=None, dedup=True)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert len(re.findall(r"[+-] Sort ", plan)) == 1


def test_redelivered_events_count_once(spark):
    rows = [(f"e{i % 2}", None, None, "1.2.3.4", 22, "sshd", "", None) for i in range(8)]
    df = events(spark, *rows).withColumn("timestamp", F.timestamp_micros(F.substring("event_id", 2, 1).cast("bigint")))
    rules = [parse_rule(THRESHOLD.replace("threshold: 5", "threshold: 2")), Rule("one", "n", "single", conditions=(Condition("service", "eq", "sshd"),))]
    for hot_rows in (None, 3):
        got = sorted((r.rule_id, r.event_id) for r in evaluate(df, rules, hot_rows=hot_rows, dedup=True).collect())
        assert got == [("one", "e0"), ("one", "e1"), ("r2", "e1")]
    assert evaluate(df, rules).filter("rule_id = 'r2'").count() == 4
