"""Stateful streaming forms of the ordered operators.

Rows wait in state until the watermark passes them, then they are folded in ``(ts, id)`` order, so a stream gives the
rows a batch gives for everything that was not late. The rows do not carry the watermark column, so the engine drops
none: a late row is folded when it comes, after what was folded before it.

State is split by the grouping key. Rows wait in slots of time, so a timer reads the slots that are due and one more at
most, however many rows wait behind. A key has one timer for its earliest waiting row: after each micro-batch all rows
the watermark has passed are out, of all keys alike.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SLOTS_PER_DELAY = 64
RING_BLOCK = 512
BLOCKS_HELD = 4
SLOT_KEY = T.StructType([T.StructField("slot", T.LongType())])
TEXT = T.StructType([T.StructField("text", T.StringType())])


class Ring:
    """Times by arrival number, in blocks. A call holds a few blocks; each is read once and written once."""

    def __init__(self, state) -> None:
        self.state, self.blocks, self.changed, self.stored = state, {}, set(), set()
        self.reads = self.writes = 0

    def _block(self, number: int) -> list[int]:
        block = self.blocks.get(number)
        if block is None:
            if len(self.blocks) >= BLOCKS_HELD:
                self._put(min(self.blocks))
            stored = self.state.getValue((number,)) if self.state.containsKey((number,)) else None
            self.reads += 1
            if stored:
                self.stored.add(number)
            block = self.blocks[number] = json.loads(stored[0]) if stored else []
        return block

    def _put(self, number: int) -> None:
        block = self.blocks.pop(number)
        if number in self.changed:
            self.state.updateValue((number,), (json.dumps(block),))
            self.changed.discard(number)
            self.stored.add(number)
            self.writes += 1

    def append(self, place: int, ts: int) -> None:
        number, at = divmod(place, RING_BLOCK)
        block = self._block(number)
        del block[at:]
        block.append(ts)
        self.changed.add(number)

    def at(self, place: int) -> int:
        number, at = divmod(place, RING_BLOCK)
        return self._block(number)[at]

    def forget(self, low: int, high: int) -> None:
        """Blocks whose places all lie from ``low`` up to ``high``; to be called as ``low`` moves on."""
        for number in range(low // RING_BLOCK, high // RING_BLOCK):
            fresh = self.blocks.pop(number, None) is not None and number not in self.stored
            self.changed.discard(number)
            if not fresh:
                self.state.removeKey((number,))

    def save(self) -> None:
        for number in sorted(self.blocks):
            self._put(number)


@dataclass(frozen=True)
class Fold:
    """``step(state, ts, steps, ring) -> (state, picked)``; ``ends(state)`` is the last instant the state matters."""

    schema: T.StructType
    initial: tuple
    step: Callable[[tuple, int, int, Ring], tuple[tuple, bool]]
    ends: Callable[[tuple], int | None]


def window_fold(span_micros: int, inclusive: bool) -> Fold:
    """First row per window: used for suppression (inclusive) and de-duplication (exclusive)."""
    span = span_micros if inclusive else span_micros - 1

    def step(state, ts, _, ring):
        (until,) = state
        return ((ts + span,), True) if until is None or ts > until else (state, False)

    return Fold(T.StructType([T.StructField("until", T.LongType())]), (None,), step, lambda state: state[0])


def threshold_fold(window_micros: int, wanted: int) -> Fold:
    """Counts arrivals since the last fire; a row compares itself with the one ``wanted - 1`` places before it, so its
    cost does not grow with ``wanted``."""

    def step(state, ts, _, ring):
        n, _ = state
        n = n or 0
        ring.append(n, ts)
        n += 1
        if n >= wanted and ring.at(n - wanted) > ts - window_micros:
            ring.forget(max(n - 1 - wanted, 0), n + RING_BLOCK)
            return (0, None), True
        ring.forget(max(n - 1 - wanted, 0), max(n - wanted, 0))
        return (n, ts), False

    fields = [T.StructField("held", T.LongType()), T.StructField("newest", T.LongType())]
    return Fold(T.StructType(fields), (0, None), step, lambda state: None if state[1] is None else state[1] + window_micros)


def sequence_fold(window_micros: int, needed: list[int]) -> Fold:
    def step(state, ts, steps, ring):
        at, count, began = state
        if began is not None and ts - began > window_micros:
            at, count, began = 0, 0, None
        if not steps >> at & 1:
            return (at, count, began), False
        began = ts if began is None else began
        count += 1
        if count < needed[at]:
            return (at, count, began), False
        if at + 1 < len(needed):
            return (at + 1, 0, began), False
        return (0, 0, None), True

    fields = [T.StructField("at", T.IntegerType()), T.StructField("count", T.IntegerType()), T.StructField("began", T.LongType())]
    return Fold(T.StructType(fields), (0, 0, None), step, lambda state: None if state[2] is None else state[2] + window_micros)


def _plain(value: Any) -> Any:
    return None if value is None or pd.isna(value) else int(value)


class OrderedProcessor(StatefulProcessor):
    """Folds each key's rows once the watermark has passed them.

    ``choose(key)`` gives the fold of a key, so several rules share one query. With ``keep_all`` every row
    comes out with its decision, else the picked ones only. A null id counts as the empty one.
    """

    def __init__(self, choose: Callable[[tuple], Fold], state_schema: T.StructType, key_names: list[str], keep_all: bool, delay_micros: int):
        self.choose, self.state_schema, self.key_names, self.keep_all = choose, state_schema, key_names, keep_all
        self.width = max(1_000, delay_micros // SLOTS_PER_DELAY)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", SLOT_KEY, TEXT)
        self.slots = handle.getValueState("slots", TEXT)
        self.folded = handle.getValueState("folded", self.state_schema)
        self.ring = handle.getMapState("ring", SLOT_KEY, TEXT)

    def _known(self) -> list[int]:
        return json.loads(self.slots.get()[0]) if self.slots.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list] = {}
        oldest = None
        for frame in rows:
            for ts, name, steps, payload in zip(frame.ts.tolist(), frame.id.tolist(), frame.steps.tolist(), frame.payload.tolist()):
                fresh.setdefault(int(ts) // self.width, []).append([int(ts), name or "", int(steps), payload])
                oldest = int(ts) if oldest is None else min(oldest, int(ts))
        if oldest is None:
            return iter(())
        known = self._known()
        for slot, arrived in fresh.items():
            if slot in known:
                arrived = json.loads(self.waiting.getValue((slot,))[0]) + arrived
            self.waiting.updateValue((slot,), (json.dumps(arrived),))
        self.slots.update((json.dumps(sorted({*known, *fresh})),))
        self.handle.registerTimer(oldest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = (timerValues.getCurrentWatermarkInMs() - 1) * 1000  # rows before it are due, for every key
        fold, slots, due, later = self.choose(key), self._known(), [], None
        while slots and slots[0] * self.width < mark and later is None:
            rows = sorted(json.loads(self.waiting.getValue((slots[0],))[0]), key=lambda r: (r[:3], r[3] or ""))
            n = sum(row[0] < mark for row in rows)
            due += rows[:n]
            if n < len(rows):
                later = rows[n:]
                if n:
                    self.waiting.updateValue((slots[0],), (json.dumps(later),))
            else:
                self.waiting.removeKey((slots.pop(0),))
        if slots:
            self.slots.update((json.dumps(slots),))
            self.handle.registerTimer((later[0][0] if later else slots[0] * self.width) // 1000 + 1)
        elif self.slots.exists():
            self.slots.clear()
        state, ring, out = self._read(fold), Ring(self.ring), []
        for ts, name, steps, payload in due:
            state, picked = fold.step(state, ts, steps, ring)
            if picked or self.keep_all:
                out.append((*key, ts, name, payload, picked))
        ring.save()
        self._write(fold, state, bool(slots), mark)
        if out:
            yield pd.DataFrame(out, columns=[*self.key_names, "ts", "id", "payload", "picked"])

    def _read(self, fold: Fold) -> tuple:
        if not self.folded.exists():
            return fold.initial
        return tuple(_plain(v) for v in self.folded.get())[: len(fold.initial)]

    def _write(self, fold: Fold, state: tuple, waiting: bool, mark: int) -> None:
        """Drop state that can no longer matter, else wake up again when it ends."""
        ends = fold.ends(state)
        if ends is None or (ends < mark and not waiting):
            if self.folded.exists():
                self.folded.clear()
            if self.ring.exists():
                self.ring.clear()
            return
        self.folded.update(state)
        if not waiting:
            self.handle.registerTimer(max(ends, mark) // 1000 + 2)

    def close(self) -> None:
        pass
