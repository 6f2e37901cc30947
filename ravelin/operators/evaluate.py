"""Rule evaluation: single, threshold and sequence rules over one pass and one shuffle.

Each event is tested against all rules by native columns; the rows that match become
``(rule_ix, group_key, ts, event_id, steps)`` plus carried columns. All stateful rules share one exchange
on ``(rule_ix, group_key)``. A threshold row can only fire when the row ``threshold - 1`` places earlier
is inside the window, which a lag decides natively, so few rows reach the ordered pass.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.times import micros
from ravelin.operators import rules as R
from ravelin.operators.conditions import conditions_column, group_key
from ravelin.operators.ruleindex import INDEXED_FROM, STORED_FIELDS, match_indexed
from ravelin.session import materialise
from ravelin.operators.ordered import (
    CHUNK_ROWS,
    FAR,
    HOT_ROWS,
    SEED,
    hot_keys,
    pick_hot,
    pick_in_order,
    rank_hot,
    sample_fraction,
    split_hot,
)

KEYS = ["rule_ix", "group_key"]
ORDER = ["ts", "event_id"]
CARRIED = ("timestamp", "metadata")
NO_RULE = R.Rule("none", "none", R.SINGLE)


def _step_bits(rules: Sequence[tuple[int, R.Rule]]) -> int:
    bits = max([len(r.steps) for _, r in rules if r.type == R.SEQUENCE] + [1])
    if max(i for i, _ in rules).bit_length() + bits > 62:
        raise ValueError("too many rules and steps for one number")
    return bits


def _hit(index: int, rule: R.Rule, bits: int) -> Column:
    """The rule's index and its matched steps in one number, else null. Bit ``s`` stands for step ``s``."""
    base = index << bits
    if rule.type != R.SEQUENCE:
        return F.when(conditions_column(rule.conditions), F.lit(base | 1).cast("bigint"))
    tests = [conditions_column(step.conditions) for step in rule.steps]
    flags = [F.when(test, F.lit(1 << s)).otherwise(F.lit(0)).cast("bigint") for s, test in enumerate(tests)]
    return F.when(reduce(Column.__or__, tests), F.lit(base).cast("bigint") + reduce(Column.__add__, flags))


def _group_keys(rules: Sequence[tuple[int, R.Rule]]) -> Column:
    """The group key of the row's rule; rules with the same fields share one expression."""
    specs = list(dict.fromkeys(rule.group_by for _, rule in rules))
    if len(specs) == 1:
        return group_key(specs[0])
    place = per_rule({index: specs.index(rule.group_by) for index, rule in rules})
    key = group_key(specs[0])
    for number, spec in enumerate(specs[1:], 1):
        key = F.when(place == number, group_key(spec)).otherwise(key)
    return key


def per_rule(values: dict[int, int]) -> Column:
    """The value of the row's rule, looked up by position in a literal array."""
    told = json.dumps([values.get(i, 0) for i in range(max(values) + 1)])
    return F.get(F.from_json(F.lit(told), "array<bigint>"), F.col("rule_ix"))


def _needed(rules: Sequence[tuple[int, R.Rule]]) -> Column | None:
    """A test on stored columns that every match passes. It reaches below enrichment to the scan; tests on
    metadata are left to the match itself."""
    alternatives = []
    for _, rule in rules:
        for part in [s.conditions for s in rule.steps] if rule.type == R.SEQUENCE else [rule.conditions]:
            tests = [
                F.col("type" if c.field == "event_type" else c.field) == c.value
                for c in part
                if c.op == "eq" and c.value and c.field in STORED_FIELDS
            ]
            if not part:
                continue
            if not tests:
                return None
            alternatives.append(reduce(Column.__and__, tests))
    return reduce(Column.__or__, alternatives) if alternatives else None


def match(df: DataFrame, rules: Sequence[tuple[int, R.Rule]], carried: Sequence[str], indexed_from: int = INDEXED_FROM) -> DataFrame:
    """One row per (event, rule) whose conditions, or any step's conditions, hold. Up to ``indexed_from`` rules are one
    compiled projection: a number per rule, nulls removed, exploded; more are found through an index. An event without
    time counts as at time zero; one without an id has the empty id."""
    at, named = F.coalesce(micros(F.col("timestamp")), F.lit(0)).alias("ts"), F.coalesce("event_id", F.lit("")).alias("event_id")
    if len(rules) >= indexed_from:
        return match_indexed(df, rules).select("rule_ix", "group_key", "steps", at, named, *carried)
    needed = _needed(rules)
    df = df if needed is None else df.filter(needed)
    bits = _step_bits(rules)
    found = F.array_except(F.array(*[_hit(index, rule, bits) for index, rule in rules]), F.array(F.lit(None).cast("bigint")))
    hits = df.withColumn("hit", F.explode(found)).withColumn("rule_ix", F.shiftright("hit", bits).cast("int"))
    return hits.select(
        "rule_ix",
        _group_keys(rules).alias("group_key"),
        F.col("hit").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).alias("steps"),
        at,
        named,
        *carried,
    )


def _pass(rules: dict[int, R.Rule]):
    """State of the ordered pass: a reach for thresholds, (step, count, start) for sequences."""
    thresholds = {i: r.threshold for i, r in rules.items() if r.type == R.THRESHOLD}
    sequences = {i: ([s.required for s in r.steps], r.window_micros) for i, r in rules.items() if r.type == R.SEQUENCE}

    def picker():
        covered, step, count, began = 0, 0, 0, None

        def decide(new_key, rule_ix, ts, steps, rn):
            nonlocal covered, step, count, began
            if new_key:
                covered, step, count, began = 0, 0, 0, None
            if rule_ix in thresholds:
                if rn <= covered:
                    return False
                covered = rn + thresholds[rule_ix] - 1
                return True
            if rule_ix not in sequences:
                return True
            needed, window = sequences[rule_ix]
            if began is not None and ts - began > window:
                step, count, began = 0, 0, None
            if not steps >> step & 1:
                return False
            if began is None:
                began = ts
            count += 1
            if count < needed[step]:
                return False
            step, count = step + 1, 0
            if step < len(needed):
                return False
            step, began = 0, None
            return True

        return decide

    return picker


def _tight(rules: dict[int, R.Rule], lagged) -> Column:
    """The row ``threshold - 1`` places earlier is strictly inside the window; true for other rules."""
    wanted = {i: r.threshold for i, r in rules.items() if r.type == R.THRESHOLD}
    if not wanted:
        return F.lit(True)
    window = per_rule({i: r.window_micros for i, r in rules.items()})
    wanted_here, test = F.coalesce(per_rule(wanted), F.lit(0)), F.lit(True)
    for count in sorted(set(wanted.values()) - {1}):
        inside = F.coalesce(F.col("ts") - lagged(count - 1) < window, F.lit(False))
        test = F.when(wanted_here == count, inside).otherwise(test)
    return test


def _ordinary(matched: DataFrame, rules: dict[int, R.Rule], dedup: bool) -> DataFrame:
    """Every window and the ordered pass share one exchange and one sort."""
    along = Window.partitionBy(*KEYS).orderBy(*ORDER)
    if dedup:
        here, before = F.struct(*ORDER), F.lag(F.struct(*ORDER)).over(along)
        repeated = matched.withColumn("repeated", F.coalesce(here == before, F.lit(False)) & (F.col("event_id") != ""))
        matched = repeated.filter(~F.col("repeated")).drop("repeated")
    numbered = matched.withColumn("rn", F.row_number().over(along).cast("bigint")).withColumn(
        "tight", _tight(rules, lambda back: F.lag("ts", back).over(along))
    )
    live = numbered.filter("tight").drop("tight")
    return pick_in_order(live, KEYS, ORDER, ["rule_ix", "ts", "steps", "rn"], _pass(rules))


def _hot_thresholds(ranked: DataFrame, rules: dict[int, R.Rule]) -> DataFrame:
    """Each row of a threshold rule that can fire, as an interval over the rows it would use up."""
    wanted = {i: r.threshold for i, r in rules.items() if r.type == R.THRESHOLD}
    rows = ranked.filter(F.col("rule_ix").isin(*wanted)).withColumn("back", per_rule(wanted) - 1)
    earlier = rows.select(*KEYS, (F.col("rn") + F.col("back")).alias("rn"), F.col("ts").alias("earlier"))
    window = per_rule({i: rules[i].window_micros for i in wanted})
    full = rows.join(earlier, [*KEYS, "rn"]).filter((F.col("back") == 0) | (F.col("ts") - F.col("earlier") < window))
    zero = F.lit(0).cast("bigint")
    return full.select(
        *KEYS,
        "rn",
        F.col("rn").alias("fired_rn"),
        zero.alias("start_a"),
        F.col("rn").alias("start_b"),
        zero.alias("reach_a"),
        (F.col("rn") + F.col("back")).alias("reach_b"),
    )


def _hot_sequence(ranked: DataFrame, index: int, rule: R.Rule) -> DataFrame:
    """Each row of step 0 is a possible start. Its end follows from running counts per step by equality
    joins on ``(key, count)``, which spread a hot key evenly."""
    rows = ranked.filter(F.col("rule_ix") == index)
    counts = [f"n_step_{s}" for s in range(len(rule.steps))]
    starts = rows.filter(F.col("step_0")).select(
        *KEYS, F.col("rn").alias("first_rn"), F.col("ts").alias("first_ts"), (F.col(counts[0]) - 1).alias("seen")
    )
    ended = starts
    for s, step in enumerate(rule.steps):
        last = s + 1 == len(rule.steps)
        hits = rows.filter(F.col(f"step_{s}")).select(
            *KEYS,
            F.col(counts[s]).alias("wanted"),
            F.col("rn").alias("end_rn"),
            F.col("ts").alias("end_ts"),
            *([] if last else [F.col(counts[s + 1]).alias("passed")]),
        )
        wanted = ended.withColumn("wanted", F.col("seen") + step.required).select(
            *KEYS, "first_rn", "first_ts", "wanted"
        )
        ended = wanted.join(hits, [*KEYS, "wanted"]).filter(F.col("end_ts") - F.col("first_ts") <= rule.window_micros)
        ended = ended.withColumnRenamed("passed", "seen")
    ends = ended.select(*KEYS, "first_rn", "end_rn", "end_ts")
    reached = starts.drop("seen").join(ends, [*KEYS, "first_rn"], "left")
    complete = F.col("end_rn").isNotNull()
    return reached.select(
        *KEYS,
        F.col("first_rn").alias("rn"),
        F.when(complete, F.col("end_rn")).alias("fired_rn"),
        F.col("first_ts").alias("start_a"),
        F.col("first_rn").alias("start_b"),
        F.when(complete, F.col("end_ts")).otherwise(F.col("first_ts") + rule.window_micros).alias("reach_a"),
        F.when(complete, F.col("end_rn")).otherwise(F.lit(FAR)).alias("reach_b"),
    )


def _hot(matched: DataFrame, rules: dict[int, R.Rule], hot: DataFrame, hot_rows: int, chunk_rows: int) -> DataFrame:
    """The fires of all hot groups: the intervals of all their rules are solved in one call."""
    deepest = max([len(r.steps) for r in rules.values()] + [0])
    names = [f"step_{s}" for s in range(deepest)]
    present = {row.rule_ix for row in hot.select("rule_ix").distinct().collect()}
    kinds = {kind: {i: r for i, r in rules.items() if i in present and r.type == kind} for kind in (R.SINGLE, R.THRESHOLD, R.SEQUENCE)}
    parts = [matched.filter(F.col("rule_ix").isin(*kinds[R.SINGLE]))] if kinds[R.SINGLE] else []
    if kinds[R.THRESHOLD] or kinds[R.SEQUENCE]:
        ordered = matched.filter(F.col("rule_ix").isin(*kinds[R.THRESHOLD], *kinds[R.SEQUENCE]))
        flagged = ordered.select("*", *[(F.shiftright("steps", s).bitwiseAND(1) == 1).alias(n) for s, n in enumerate(names)])
        ranked = rank_hot(flagged, KEYS, "ts", ["event_id"], hot.filter(F.col("rule_ix").isin(*kinds[R.THRESHOLD], *kinds[R.SEQUENCE])), hot_rows, names)
        nodes = [_hot_thresholds(ranked, kinds[R.THRESHOLD])] if kinds[R.THRESHOLD] else []
        nodes += [_hot_sequence(ranked, index, rule) for index, rule in kinds[R.SEQUENCE].items()]
        taken = pick_hot(materialise(reduce(DataFrame.unionByName, nodes)), KEYS, "rn", None, hot_rows, chunk_rows)
        fired = taken.filter("fired_rn IS NOT NULL").select(*KEYS, F.col("fired_rn").alias("rn"))
        parts.append(ranked.join(fired, [*KEYS, "rn"]).select(*matched.columns))
    return reduce(DataFrame.unionByName, parts).select(*matched.columns)


def _once(matched: DataFrame) -> DataFrame:
    """One of each group of copies; events without an id are all different."""
    return matched.filter("event_id <> ''").dropDuplicates([*KEYS, *ORDER]).unionByName(matched.filter("event_id = ''"))


def constants(results: DataFrame, rules: Sequence[R.Rule]) -> DataFrame:
    """Adds ``rule``, the fixed text of each rule, from a literal array indexed by position, or for many rules from a
    broadcast table."""
    if len(rules) >= INDEXED_FROM:
        rows = [(i, (r.id, r.name, r.severity, r.severity_name, {R.SINGLE: 1, R.THRESHOLD: r.threshold}.get(r.type, len(r.steps)), list(r.tags))) for i, r in enumerate(rules)]
        text = "rule_id:string,rule_name:string,rule_severity:string,severity:string,event_count:bigint,tags:array<string>"
        return results.join(F.broadcast(results.sparkSession.createDataFrame(rows, f"rule_ix int, rule struct<{text}>")), "rule_ix")
    fixed = []
    for rule in list(rules) or [NO_RULE]:
        count = {R.SINGLE: 1, R.THRESHOLD: rule.threshold}.get(rule.type, len(rule.steps))
        fixed.append(
            F.struct(
                F.lit(rule.id).alias("rule_id"),
                F.lit(rule.name).alias("rule_name"),
                F.lit(rule.severity).alias("rule_severity"),
                F.lit(rule.severity_name).alias("severity"),
                F.lit(count).cast("bigint").alias("event_count"),
                F.array(*[F.lit(t) for t in rule.tags]).cast("array<string>").alias("tags"),
            )
        )
    return results.withColumn("rule", F.get(F.array(*fixed), F.col("rule_ix")))


def evaluate(
    df: DataFrame,
    rules: Sequence[R.Rule],
    carried: Sequence[str] = CARRIED,
    hot_rows: int | None = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    dedup: bool = False,
    hot_groups: DataFrame | None = None,
) -> DataFrame:
    """All enabled rules over canonical events.

    Result: ``rule_ix, rule_id, rule_name, rule_severity, severity, tags, group_key, event_count,
    event_id, event_ids`` and the ``carried`` columns of the firing event. Events count in
    ``(timestamp, event_id)`` order; sequences run on event time. A threshold window restarts when it
    fires. Groups are global, wherever their events were seen. With ``dedup`` a redelivered event (same
    rule, group, id and time) counts once, for all kinds of rules; events without an id are never copies
    of each other. All rules then share one scan and one exchange. An event without time counts as at
    time zero. ``hot_groups`` (``rule_ix, group_key, hot_n``), if the caller knows them, spares the
    sampling pass.
    """
    rules = R.check_distinct_ids(list(rules))
    live = [(i, r) for i, r in enumerate(rules) if r.enabled]
    passing = [] if dedup else [(i, r) for i, r in live if r.type == R.SINGLE]
    ordered = dict([x for x in live if x not in passing])
    fired = []
    if passing:
        fired.append(match(df, passing, carried).drop("ts", "steps"))
    if ordered:
        matched = match(df, list(ordered.items()), carried)
        hot = hot_groups
        if hot is None and hot_rows:
            sample = match(df.sample(sample_fraction(hot_rows), SEED), list(ordered.items()), ())
            hot = hot_keys(matched, KEYS, "ts", hot_rows, sample)
        cold = matched
        if hot is not None:
            cold, warm = split_hot(matched, KEYS, hot)
            hot_fires = _hot(_once(warm) if dedup else warm, ordered, hot, hot_rows or HOT_ROWS, chunk_rows)
            fired.append(hot_fires.drop("ts", "steps"))
        fired.append(_ordinary(cold, ordered, dedup).drop("ts", "steps", "rn"))
    if not fired:
        fired.append(match(df, [(0, NO_RULE)], carried).drop("ts", "steps"))
    results = reduce(DataFrame.unionByName, fired)
    return constants(results, rules).select(
        "rule_ix",
        "rule.*",
        "group_key",
        "event_id",
        F.array("event_id").alias("event_ids"),
        *carried,
    )
