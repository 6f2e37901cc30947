"""An inverted index from what a rule asks for to the rule, for sets of many rules.

Each list of conditions names one access test: the equality used by the fewest others, else a ``contains``. Events
probe equalities by one broadcast hash lookup per field. The needles of a field form one prefix-tree pattern that finds
the longest needle at every place of the text; shorter needles that begin it are listed with it. Only the rules so found
are tested in full, and their tests are data, not generated code: the size of the plan follows the fields in use and not
the number of rules, and the cost of an event follows the rules it meets. Lists of conditions without an access test are
met by every event.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.names import free
from ravelin.functions.patterns import java_pattern
from ravelin.operators import rules as R
from ravelin.operators.conditions import field, group_key

INDEXED_FROM = 64  # rules; fewer are tested faster as one compiled projection
MOST_SLOTS = 16  # fields with a hash lookup of their own; rules of rarer fields are met by every event
OPS = ["eq", "neq", "contains", "regex", "exists"]
STORED_FIELDS = ["type", "event_type", "hostname", "source_ip", "destination_ip", "user", "process", "service", "agent_id"]


def parts_of(rule: R.Rule) -> list[tuple[int, tuple[R.Condition, ...]]]:
    """The rule's lists of conditions that can hold at all, each with its bit."""
    lists = [(1 << s, step.conditions) for s, step in enumerate(rule.steps)] if rule.type == R.SEQUENCE else [(1, rule.conditions)]
    return [(bit, tests) for bit, tests in lists if tests and all(_possible(t) for t in tests)]


def _possible(test: R.Condition) -> bool:
    return test.op in OPS and (test.op != "regex" or java_pattern(test.value) is not None)


def _name(test: R.Condition) -> str:
    return "type" if test.field == "event_type" else test.field


class RuleIndex:
    def __init__(self, rules: Sequence[tuple[int, R.Rule]]) -> None:
        self.rules = [(i, r, parts_of(r)) for i, r in rules]
        self.rules = [(i, r, parts) for i, r, parts in self.rules if parts]
        lists = [(i, tests) for i, _, parts in self.rules for _, tests in parts]
        used = Counter((_name(t), t.value) for _, tests in lists for t in {t for t in tests if t.op == "eq"})
        fields = Counter(_name(t) for _, tests in lists for t in tests if t.op == "eq")
        slots = {name for name, _ in sorted(fields.items(), key=lambda x: (-x[1], x[0]))[:MOST_SLOTS]}
        self.equal: dict[str, dict[str, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.needles: dict[str, dict[str, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.always: set[int] = set()
        for i, tests in lists:
            equal = [t for t in tests if t.op == "eq" and _name(t) in slots]
            needles = [t for t in tests if t.op == "contains" and t.value]
            if equal:
                access = min(equal, key=lambda t: used[_name(t), t.value])
                self.equal[_name(access)][access.value].add(i)
            elif needles:
                access = max(needles, key=lambda t: len(t.value))
                self.needles[_name(access)][access.value].add(i)
            else:
                self.always.add(i)
        self.fields = list(dict.fromkeys(_name(t) for _, tests in lists for t in tests))

    def needed(self) -> Column | None:
        """A test on stored columns that every match passes, if there is one; it reaches the scan."""
        if self.always or self.needles or any(name not in STORED_FIELDS or "" in values for name, values in self.equal.items()):
            return None
        tests = [F.col(name).isin(sorted(values)) for name, values in self.equal.items()]
        return reduce(Column.__or__, tests) if tests else None

    def tests(self, spec_of: dict[int, int]) -> list[tuple]:
        """A row per rule: its number, the place of its group fields, its lists of tests."""
        place = {name: n for n, name in enumerate(self.fields)}
        rows = []
        for i, _, parts in self.rules:
            told = [(bit, [(place[_name(t)], OPS.index(t.op), java_pattern(t.value) if t.op == "regex" else t.value) for t in tests]) for bit, tests in parts]
            rows.append((i, spec_of[i], told))
        return rows


def needle_pattern(needles: Sequence[str]) -> str:
    """A pattern that matches the longest needle that begins where it is tried: the prefix tree of the needles."""
    tree: dict = {}
    for needle in needles:
        node = tree
        for char in needle:
            node = node.setdefault(char, {})
        node[""] = {}

    def told(node: dict) -> str:
        branches = []
        for char, child in sorted(node.items()):
            if not char:
                continue
            text = char
            while len(child) == 1 and "" not in child:
                (char, child), = child.items()
                text += char
            below = told(child)
            quoted = re.sub(r"([^\w\s]|_)", lambda m: "\\" + m[0] if m[0].isascii() else m[0], text)
            branches.append(quoted + (f"(?:{below})" + ("?" if "" in child else "") if below else ""))
        return "|".join(branches)

    return told(tree)


def _json_literal(value, kind: str) -> Column:
    """A constant of any size that the optimizer folds once."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def found_needles(name: str, needles: dict[str, set[int]]) -> Column:
    """The rules of all needles in the field's text."""
    longest = {n: sorted({i for m, own in needles.items() if n.startswith(m) for i in own}) for n in needles}
    rules = _json_literal(longest, "map<string,array<int>>")
    hits = F.array_distinct(F.regexp_extract_all(field(name), F.lit(f"(?=({needle_pattern(list(needles))}))"), F.lit(1)))
    return F.flatten(F.transform(hits, lambda hit: F.try_element_at(rules, hit)))


def _holds(texts: Column, test: Column) -> Column:
    text, value = F.get(texts, test["field"]), test["value"]
    return (
        F.when(test["op"] == 0, text == value)
        .when(test["op"] == 1, text != value)
        .when(test["op"] == 2, text.contains(value))
        .when(test["op"] == 3, F.rlike(text, value))
        .otherwise(text != "")
    )


def match_indexed(df: DataFrame, rules: Sequence[tuple[int, R.Rule]]) -> DataFrame:
    """``df`` with ``rule_ix``, ``group_key`` and ``steps``: one row per event and rule with a list of conditions that
    holds, whose bits ``steps`` has."""
    spark, index = df.sparkSession, RuleIndex(rules)
    columns = df.columns
    needed = index.needed()
    rows = df if needed is None else df.filter(needed)
    met, texts, ids, lists, spec, rule_ix, mask, *slots = free(df, "met", "texts", "ids", "lists", "spec", "rule_ix", "steps", *(f"{kind}_{n}" for n in range(len(index.equal)) for kind in ("value", "hit")))
    nothing = F.array().cast("array<int>")
    found = [F.array(*[F.lit(i) for i in sorted(index.always)])] if index.always else []
    for n, (name, values) in enumerate(index.equal.items()):
        own, hit = slots[2 * n : 2 * n + 2]
        table = spark.createDataFrame([(v, sorted(own_rules)) for v, own_rules in values.items()], f"{own} string, {hit} array<int>")
        rows = rows.join(F.broadcast(table), field(name) == F.col(own), "left").drop(own)
        found.append(F.coalesce(F.col(hit), nothing))
    found += [F.coalesce(found_needles(name, needles), nothing) for name, needles in index.needles.items()]
    specs = list(dict.fromkeys(rule.group_by for _, rule in rules)) or [()]
    spec_of = {i: specs.index(rule.group_by) for i, rule in rules}
    tests = spark.createDataFrame(index.tests(spec_of), f"{ids} int, {spec} int, {lists} array<struct<bit:bigint,tests:array<struct<field:int,op:int,value:string>>>>")
    candidates = F.array_distinct(F.concat(*found)) if found else nothing
    rows = rows.withColumn(met, candidates).filter(F.size(met) > 0).select(*columns, F.array(*[field(n) for n in index.fields]).cast("array<string>").alias(texts), F.explode(met).alias(rule_ix))
    rows = rows.join(F.broadcast(tests), F.col(rule_ix) == F.col(ids)).drop(ids)

    def hit_bits(m: Column, part: Column) -> Column:
        return F.when(F.forall(part["tests"], lambda test: _holds(F.col(texts), test)), m.bitwiseOR(part["bit"])).otherwise(m)

    rows = rows.withColumn(mask, F.aggregate(lists, F.lit(0).cast("bigint"), hit_bits)).filter(F.col(mask) != 0)
    key = group_key(specs[0])
    for number, fields in enumerate(specs[1:], 1):
        key = F.when(F.col(spec) == number, group_key(fields)).otherwise(key)
    return rows.select(*columns, F.col(rule_ix).alias("rule_ix"), key.alias("group_key"), F.col(mask).alias("steps"))
