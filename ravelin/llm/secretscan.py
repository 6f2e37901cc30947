"""Secret scan with one deterministic automaton for all rules.

Each rule's regular expression becomes a non-deterministic automaton. Subset construction over attempts ordered by
their start gives a machine that follows leftmost-longest, non-overlapping matches without going back; the machines
are minimised, combined into their product, minimised again and laid out as one transition array. A text is scanned
once, byte by byte, for all rules; the start of a match, found at its end, comes from the reversed automaton.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field
from functools import cache, cached_property
from re import _constants as sre  # names of the nodes of the standard library's parse tree
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import batches, text_rows


@dataclass(frozen=True)
class SecretRule:
    """``min_chars`` counts the whole match or, if ``value`` is set, what follows its first ``:`` or ``=``, spaces
    and a quote. Shorter matches are dropped after matching, so they still hide what lies inside them."""

    kind: str
    pattern: str
    ignore_case: bool = False
    min_chars: int = 1
    value: bool = False


def _private_key() -> str:
    """A private key with its body. Up to an END mark the body is what keys are written with, in lines, joined by
    spaces or quoted. Without one it is the header fields and the runs of base64 on lines of their own, however short,
    or of 12 and more characters after spaces, with the rest of a cut run. Line ends may be escaped."""
    name = "((RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY-----"
    blank, base64 = r"[\x20\x09]", "[A-Za-z0-9+/=]"
    gap = r"([\x20\x09\x0D\x0A]|\\[nr])"
    line = rf"{blank}*(\x0D|\x0A|\\[nr]){gap}*{base64}+"
    entry = rf"{gap}+[A-Za-z]+(-[A-Za-z]+)+:{blank}*[A-Za-z0-9+/=,]+(-[A-Za-z0-9+/=,]+)*"
    run = rf"{blank}*{base64}{{12,}}"
    marked = r"""(-?[A-Za-z0-9+/=:,>"'\\\x20\x09\x0D\x0A])*-----END """ + name
    return f"-----BEGIN {name}({marked}|({entry}|{line}|{run})+({blank}+{base64}+)?)?"


BASE_KINDS = ("assign", "access", "hex")
RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 6, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", min_chars=20),
    SecretRule("hex", r"[0-9a-f]{24,}", min_chars=24),
    SecretRule("pem", _private_key()),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", min_chars=40),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]+", min_chars=20),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", min_chars=30),
)


class Nfa:
    """Automaton of one pattern over bytes. Edges are (state, bytes, state); ``free`` are edges without a byte."""

    def __init__(self, rule: SecretRule) -> None:
        self.free: list[list[int]] = []
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.fold = rule.ignore_case
        self.start = self._state()
        self.end = self._sequence(_parser.parse(rule.pattern), self.start)

    def _state(self) -> int:
        self.free.append([])
        self.edges.append([])
        return len(self.free) - 1

    def _bytes(self, codes) -> frozenset:
        if max(codes) > 127:
            raise ValueError("patterns are over ASCII")
        more = {ord(x) for c in codes for x in (chr(c).lower(), chr(c).upper())} if self.fold else set()
        return frozenset(codes) | more

    def _sequence(self, nodes, at: int) -> int:
        for op, arg in nodes:
            at = self._node(op, arg, at)
        return at

    def _node(self, op, arg, at: int) -> int:
        if op is sre.LITERAL:
            return self._step(at, self._bytes({arg}))
        if op is sre.IN:
            codes: set[int] = set()
            for kind, what in arg:
                if kind is sre.LITERAL:
                    codes.add(what)
                elif kind is sre.RANGE:
                    codes.update(range(what[0], what[1] + 1))
                else:
                    raise ValueError(f"not supported in a class: {kind}")
            return self._step(at, self._bytes(codes))
        if op is sre.SUBPATTERN:
            return self._sequence(arg[3], at)
        if op is sre.BRANCH:
            out = self._state()
            for way in arg[1]:
                first = self._state()
                self.free[at].append(first)
                self.free[self._sequence(way, first)].append(out)
            return out
        if op is sre.MAX_REPEAT:
            least, most, body = arg
            for _ in range(least):
                at = self._sequence(body, at)
            if most is sre.MAXREPEAT:
                again = self._state()
                self.free[at].append(again)
                self.free[self._sequence(body, again)].append(again)
                return again
            out = self._state()
            self.free[at].append(out)
            for _ in range(most - least):
                at = self._sequence(body, at)
                self.free[at].append(out)
            return out
        raise ValueError(f"not supported: {op}")

    def _step(self, at: int, codes: frozenset) -> int:
        to = self._state()
        self.edges[at].append((codes, to))
        return to

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def step(self, states, byte: int) -> frozenset:
        return self.closure({to for s in states for codes, to in self.edges[s] if byte in codes})

    def reversed(self) -> "Nfa":
        back = object.__new__(Nfa)
        back.free, back.edges = [[] for _ in self.free], [[] for _ in self.edges]
        for s, targets in enumerate(self.free):
            for t in targets:
                back.free[t].append(s)
        for s, edges in enumerate(self.edges):
            for codes, t in edges:
                back.edges[t].append((codes, s))
        back.start, back.end = self.end, self.start
        return back


def byte_classes(machines: list[Nfa]) -> tuple[bytes, list[int]]:
    """Bytes that no edge tells apart share a class: the table byte -> class and one byte of each class."""
    sets = list(dict.fromkeys(codes for m in machines for edges in m.edges for codes, _ in edges))
    classes: dict[tuple, int] = {}
    of = bytes(classes.setdefault(tuple(b in s for s in sets), len(classes)) for b in range(256))
    return of, [of.index(c) for c in range(len(classes))]


NEW, LONGER = 1, 2  # what entering a state reports: a match ends here for the first time, or the last one goes on


def minimise(moves: np.ndarray, output: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Merge states that no further input tells apart: split by output, then by the parts the moves lead to."""
    part = np.unique(output, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([part, part[moves]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    first = np.unique(part, return_index=True)[1]
    return part[moves[first]], output[first], int(part[start])


def scanner(nfa: Nfa, samples: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Subset construction over attempts. A state is the live attempts in order of their start, each a set of
    states no earlier attempt has, and whether the first has matched. A match ends all later attempts, and new
    ones start at its end."""
    seed = nfa.closure({nfa.start})
    if nfa.end in seed:
        raise ValueError("a rule must not match the empty text")
    numbers = {((), False, 0): 0}
    order, moves = [((), False, 0)], []
    for live, matched, _ in order:
        row = []
        for byte in samples:
            taken: set[int] = set()
            then, first_alive = [], False
            for i, attempt in enumerate((*live, seed)):
                got = nfa.step(attempt, byte) - taken
                if got:
                    then.append(got)
                    taken |= got
                    first_alive |= i == 0 and bool(live)
            done = next((i for i, a in enumerate(then) if nfa.end in a), None)
            still = matched and first_alive
            if done is None:
                state = (tuple(then), still, 0)
            elif done == 0:
                state = ((then[0],), True, LONGER if still else NEW)
            else:
                raise ValueError("a match of this rule may end while an earlier attempt is open")
            if state not in numbers:
                numbers[state] = len(order)
                order.append(state)
            row.append(numbers[state])
        moves.append(row)
    return minimise(np.array(moves), np.array([s[2] for s in order]), 0)


@dataclass
class Automaton:
    rules: tuple[SecretRule, ...]
    classes: bytes = b""
    moves: array = field(default_factory=lambda: array("i"))  # offset of the next row, by row offset + class
    reports: tuple = ()  # of the reporting rows, which come last: ((rule, NEW or LONGER), ...)
    first_report: int = 0
    width: int = 0
    start: int = 0

    @classmethod
    def compile(cls, rules: tuple[SecretRule, ...] = RULES) -> "Automaton":
        machines = [Nfa(r) for r in rules]
        classes, samples = byte_classes(machines)
        single = [scanner(m, samples) for m in machines]
        begin = tuple(s[2] for s in single)
        numbers, order, moves = {begin: 0}, [begin], []
        for state in order:
            row = []
            for to in zip(*(single[i][0][s].tolist() for i, s in enumerate(state))):
                if to not in numbers:
                    numbers[to] = len(order)
                    order.append(to)
                row.append(numbers[to])
            moves.append(row)
        said = [tuple((i, int(single[i][1][s])) for i, s in enumerate(state) if single[i][1][s]) for state in order]
        kinds = {x: n for n, x in enumerate(sorted(set(said)))}
        table, output, start = minimise(np.array(moves), np.array([kinds[x] for x in said]), 0)
        names = sorted(kinds)
        quiet_first = np.argsort(output != kinds[()], kind="stable")
        place = np.empty(len(quiet_first), np.int64)
        place[quiet_first] = np.arange(len(quiet_first))
        width = len(samples)
        flat = (place[table[quiet_first]] * width).reshape(-1)
        quiet = int((output == kinds[()]).sum())
        reports = tuple(names[o] for o in output[quiet_first][quiet:])
        return cls(rules, classes, array("i", flat.tolist()), reports, quiet * width, width, int(place[start]) * width)

    @cached_property
    def _moves(self) -> list[int]:
        return self.moves.tolist()

    @cached_property
    def _back(self) -> list[tuple[Nfa, dict]]:
        return [(Nfa(r).reversed(), {}) for r in self.rules]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, ordered."""
        moves, border, s = self._moves, self.first_report, self.start
        ends: list[list[int]] = [[] for _ in self.rules]
        for at, c in enumerate(data.translate(self.classes), 1):
            s = moves[s + c]
            if s >= border:
                for rule, what in self.reports[(s - border) // self.width]:
                    if what == NEW:
                        ends[rule].append(at)
                    else:
                        ends[rule][-1] = at
        out = []
        for rule, found in enumerate(ends):
            least = 0
            for end in found:
                start = self._start(rule, data, least, end)
                least = end
                if self._long_enough(self.rules[rule], data[start:end]):
                    out.append((start, rule, end))
        return sorted(out)

    def _start(self, rule: int, data: bytes, least: int, end: int) -> int:
        """Run the reversed automaton back from the end of a match to its leftmost start."""
        nfa, known = self._back[rule]
        states, start = nfa.closure({nfa.start}), end
        for i in range(end - 1, least - 1, -1):
            key = (states, data[i])
            if key not in known:
                known[key] = nfa.step(states, data[i])
            states = known[key]
            if not states:
                break
            if nfa.end in states:
                start = i
        return start

    @staticmethod
    def _long_enough(rule: SecretRule, match: bytes) -> bool:
        if rule.value:
            match = re.sub(rb"""^[^:=]*[:=]\x20*["']?""", b"", match)
        return len(match) >= rule.min_chars


@cache
def compiled(rules: tuple[SecretRule, ...]) -> Automaton:
    """The automaton of these rules, built once on the driver."""
    return Automaton.compile(rules)


def _characters(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    if not spans or data.isascii():
        return spans
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(lead)))
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


_SPANS = "doc_id long, spans array<struct<kind:string, start:long, end:long>>"
_SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def find_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``doc_id`` and the spans of all rules, by start and then in the rules' order; one row per row of ``docs``,
    no shuffle. A null or empty text has no spans; a null ``doc_id`` stays null."""
    machine = compiled(rules)

    def each(row):
        data = row[1].encode("utf-8", "surrogatepass")
        return [(row[0], [{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in _characters(data, machine.spans(data))])]

    return text_rows(docs).mapInArrow(batches(each, _SPANS_ARROW, "doc_id", "text"), _SPANS)


def masked(data: bytes, spans: list[tuple[int, int, int]], rules: tuple[SecretRule, ...]) -> bytes:
    """Each run of overlapping spans becomes one mark with the kind of its first span."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [data[at:a], b"[", rules[k].kind.encode(), b"]"]
        at = max(at, b)
    return b"".join([*out, data[at:]])


def redact(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``docs`` with the secrets in ``text`` replaced by ``[kind]``; a text without any is
    returned as it is, null included."""
    machine = compiled(rules)
    at = docs.columns.index("text")

    def run(parts):
        for part in parts:
            texts = []
            for value in part.column(at):
                text = value.as_py()
                data = (text or "").encode("utf-8", "surrogatepass")
                spans = machine.spans(data)
                texts.append(masked(data, spans, rules).decode("utf-8", "surrogatepass") if spans else text)
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text, with the digest of the base ones."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
