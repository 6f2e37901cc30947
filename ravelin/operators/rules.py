"""Detection rules: YAML text to validated dataclasses."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from ravelin.functions.durations import duration_nanos

SINGLE, THRESHOLD, SEQUENCE = "single", "threshold", "sequence"
RULE_SUFFIXES = (".yaml", ".yml")

# Rule severities; any other text is MEDIUM.
RULE_SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

# YAML spellings of a boolean and of null.
YAML_TRUE = ["true", "yes", "on", "y"]
YAML_FALSE = ["false", "no", "off", "n"]
YAML_NULL = ["", "~", "null"]


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: str = ""


@dataclass(frozen=True)
class Step:
    conditions: tuple[Condition, ...] = ()
    count: int = 1

    @property
    def required(self) -> int:
        return max(self.count, 1)


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    type: str
    description: str = ""
    enabled: bool = True
    conditions: tuple[Condition, ...] = ()
    group_by: tuple[str, ...] = ()
    threshold: int = 0
    window_micros: int = 0
    severity: str = ""
    actions: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    steps: tuple[Step, ...] = field(default=())

    @property
    def severity_name(self) -> str:
        known = self.severity if self.severity in RULE_SEVERITIES else "MEDIUM"
        return f"SEVERITY_{known}"


def _text(node: dict, key: str) -> str:
    value = node.get(key, "")
    if not isinstance(value, str):
        raise ValueError(f"{key} must be a scalar")
    return "" if value.lower() in YAML_NULL else value


def _whole(node: dict, key: str) -> int:
    return int(_text(node, key) or 0)


def _items(node: dict, key: str) -> list:
    value = node.get(key) or []
    if isinstance(value, str) and value.lower() in YAML_NULL:
        return []
    if not isinstance(value, list):
        raise ValueError(f"{key} must be a list")
    return value


def _flag(node: dict, key: str, default: bool) -> bool:
    text = _text(node, key).lower()
    if not text:
        return default
    if text not in YAML_TRUE + YAML_FALSE:
        raise ValueError(f"{key} must be a boolean")
    return text in YAML_TRUE


def _conditions(node: dict) -> tuple[Condition, ...]:
    return tuple(
        Condition(_text(c, "field"), _text(c, "op"), c.get("value", "") or "")
        for c in _items(node, "conditions")
    )


def parse_rule(text: str) -> Rule:
    """One rule from YAML. Scalars stay text, so ``value: 22`` compares as ``"22"``."""
    node = yaml.load(text, Loader=yaml.BaseLoader) or {}
    if not isinstance(node, dict):
        raise ValueError("a rule must be a mapping")
    window = _text(node, "window")
    rule = Rule(
        id=_text(node, "id"),
        name=_text(node, "name"),
        type=_text(node, "type"),
        description=_text(node, "description"),
        enabled=_flag(node, "enabled", True),
        conditions=_conditions(node),
        group_by=tuple(_items(node, "group_by")),
        threshold=_whole(node, "threshold"),
        window_micros=duration_nanos(window) // 1000 if window else 0,
        severity=_text(node, "severity"),
        actions=tuple(_items(node, "actions")),
        tags=tuple(_items(node, "tags")),
        steps=tuple(Step(_conditions(s), _whole(s, "count")) for s in _items(node, "steps")),
    )
    return validate(rule)


def validate(rule: Rule) -> Rule:
    if not rule.id:
        raise ValueError("rule has no id")
    if not rule.name:
        raise ValueError(f"rule {rule.id} has no name")
    if rule.type not in (SINGLE, THRESHOLD, SEQUENCE):
        raise ValueError(f"rule {rule.id} has unknown type {rule.type!r}")
    if rule.type in (SINGLE, THRESHOLD) and not rule.conditions:
        raise ValueError(f"{rule.type} rule {rule.id} needs conditions")
    if rule.type == THRESHOLD and rule.threshold <= 0:
        raise ValueError(f"rule {rule.id} needs a positive threshold")
    if rule.type == SEQUENCE and len(rule.steps) < 2:
        raise ValueError(f"rule {rule.id} needs two steps or more")
    if rule.type != SINGLE:
        if rule.window_micros <= 0:
            raise ValueError(f"rule {rule.id} needs a positive window")
        if not rule.group_by:
            raise ValueError(f"rule {rule.id} needs group_by")
    return rule


def check_distinct_ids(rules: list[Rule]) -> list[Rule]:
    """Two rules under one id would share state, so they are refused."""
    seen: set[str] = set()
    for rule in rules:
        if rule.id in seen:
            raise ValueError(f"duplicate rule id {rule.id}")
        seen.add(rule.id)
    return rules


def load_rules(directory: str, spark: SparkSession | None = None) -> list[Rule]:
    """All rules of a folder in file-name order; one bad file fails the load.

    With ``spark`` the folder may be on any file system Spark reads.
    """
    if spark is None:
        files = sorted(p for p in Path(directory).iterdir() if p.suffix in RULE_SUFFIXES and p.is_file())
        texts = [(p.name, p.read_text()) for p in files]
    else:
        rows = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.{yaml,yml}")
            .load(directory)
            .select("path", "content")
            .collect()
        )
        texts = sorted((os.path.basename(r.path), bytes(r.content).decode()) for r in rows)
    rules = []
    for name, text in texts:
        try:
            rules.append(parse_rule(text))
        except (ValueError, yaml.YAMLError) as error:
            raise ValueError(f"loading rule from {name}: {error}") from error
    return check_distinct_ids(rules)
