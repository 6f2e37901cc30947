"""Token ids in compressed, checksummed blocks: context mixing and a range coder.

A stream of ids is cut into blocks of equal length that are coded independently, each from a fresh model. Per block,
an order-2 and an order-1 table remember the last id after a context and how often it held, and order-0 counts cover
every id. The chances of both remembered ids are mixed from the three orders with weights that follow their success;
the range coder tells which of them came or, if neither, whether the id came before in the block, which gives it by its
order-0 share, or is new. All numbers of the coder are whole and below 2^53, and those of the model come from single
steps that IEEE rounds alike everywhere, so any machine decodes alike. Many blocks are coded side by side on arrays,
one id of each at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ravelin.llm.bpecodec import byte_letters, cut
from ravelin.llm.common import block_count, text_rows

BLOCK_IDS = 8_192
LANES = 2_048  # blocks coded side by side, at most
RENEW = 1_024  # ids between renewals of the order-0 shares, after those at powers of two
RECENT = 1 << 15  # ids the order-0 shares are made of, at most
ONE = 1 << 16
FLOOR, SEEN_FLOOR, NEW_FLOOR = 32, 128, 256  # least widths, so that one word per step of the coder is enough
ROOM = ONE - SEEN_FLOOR - NEW_FLOOR - 3 * FLOOR
ORDER1_BITS, ORDER2_BITS = 11, 12
SURE_BITS, CLASS_BITS = 2, 4  # of what is remembered, below the id: its confidence and the class of its order-0 share
ID_SHIFT = SURE_BITS + CLASS_BITS
LIMIT = 1 << 31 - ID_SHIFT  # ids are smaller
RATE = 1 / 32
BATCH = 8  # ids after which chances and weights learn; divides all steps of renewals
WORD_BITS = 24
WORD, TOP = float(1 << WORD_BITS), float(1 << 2 * WORD_BITS)  # a word; the coder's range lies between the two
ORDER2, ORDER1, SEEN, NEW = range(4)  # what tells an id
_HASH, _SHIFTS, _MASKS = 0x2545F491, np.array([[9], [17]]), np.array([[(1 << ORDER1_BITS) - 1], [(1 << ORDER2_BITS) - 1]])
_TARGETS, _NEW_RATES = np.array([0.0, 0, 0, 1]), np.array([0, 0, RATE, RATE])
# Numbers as arrays: to make them of Python numbers in every step takes as long as to add up an array of LANES.
_ONE, _UNIT, _WORD, _PER_WORD, _RATE = (np.array(float(x)) for x in (ONE, 1 / ONE, WORD, 1 / WORD, RATE))
_FLOOR, _ROOM, _TOLD, _STEP, _KEEP, _LEAVE = (np.array(float(x)) for x in (FLOOR, ROOM, ROOM + FLOOR, ROOM * RATE, ONE - NEW_FLOOR, ONE - SEEN_FLOOR - NEW_FLOOR))
_1 = np.array(1.0)
_LOW, _SURE, _SOME, _ID, _CLASS = (np.array(x, np.int32) for x in ((1 << ID_SHIFT) - 1, (1 << SURE_BITS) - 1, 1, ID_SHIFT, SURE_BITS))
_LESS = np.array(-1, np.int8)
_CLASSES = (np.minimum(np.frexp(np.arange(RECENT + 1))[1], (1 << CLASS_BITS) - 1) << SURE_BITS).astype(np.int32)


def _renewals(step: int) -> bool:
    return step and (step % RENEW == 0 or (step >= 8 and step & (step - 1) == 0))


def _marks(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids as they are remembered, with the binary logarithm of their runs as class."""
    return ids << ID_SHIFT | _CLASSES.take(lengths, mode="clip")


class Shares:
    """Order-0 shares of the ids a block had up to the last renewal: its recent ids in ascending order, in which each id
    covers a run."""

    def __init__(self) -> None:
        self.n, self.held = 0, None

    def renew(self, m: int, ids: np.ndarray, step: int) -> None:
        """``ids`` by step and lane; those of ``step`` and later are not known yet."""
        if step <= RECENT:
            held = ids[self.n : step, :m].T.copy()
            if self.n:
                held = np.concatenate((self.held[:m], held), 1)
        else:
            held = ids[step - RECENT : step, :m].T.copy()
        held.sort(1, kind="stable")
        self.held, self.n = held, held.shape[1]
        begins = np.ones((m, self.n), bool)
        np.not_equal(held[:, 1:], held[:, :-1], out=begins[:, 1:])
        starts = np.flatnonzero(begins).astype(np.int32)
        self.lengths = np.diff(starts, append=np.int32(m * self.n))  # of the runs of all lanes
        self.ids, self.firsts = held.reshape(-1)[starts], starts % self.n
        self.cuts = np.searchsorted(starts, np.arange(m + 1, dtype=np.int32) * self.n).tolist()

    def places(self) -> np.ndarray:
        """Per lane and place the run there: its id's mark, first place and length in bits from 32, 16 and 0 on."""
        out, m = np.empty(self.held.size, np.int64), len(self.held)
        for a in range(0, m, 128):
            b = min(m, a + 128)
            some = slice(self.cuts[a], self.cuts[b])
            lengths = self.lengths[some]
            runs = _marks(self.ids[some].astype(np.int64), lengths) << 32 | (self.firsts[some] << 16 | lengths)
            out[a * self.n : b * self.n] = np.repeat(runs, lengths)
        return out

    def of(self, ids: np.ndarray, size: int) -> np.ndarray:
        """First place and length, in bits from 16 and 0 on, of the runs of ``ids`` (by lane and step); zero where an id
        was not seen."""
        out, known = np.empty(ids.shape, np.int32), np.zeros(size, np.int32)
        runs = self.firsts << 16 | self.lengths
        for k, own in enumerate(ids):
            some = slice(self.cuts[k], self.cuts[k + 1])
            known[self.ids[some]] = runs[some]
            out[k] = known[own]
            known[self.ids[some]] = 0
        return out


class Model:
    """State of the blocks of all lanes, of which some are still running. Rows of arrays are orders 1 and 2, and 0. What
    is remembered changes with every id; chances and weights learn from BATCH ids at a time."""

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes)
        self.held = np.zeros((lanes << ORDER1_BITS) + (lanes << ORDER2_BITS), np.int32)
        self.chance = np.full((lanes << SURE_BITS + 1) + (lanes << CLASS_BITS), 0.25)
        self.weights = np.full((3, lanes), ROOM / 3)
        self.new = np.full(lanes, 0.5)  # chance of a new id where neither remembered one came
        self.base = np.array([lane << ORDER1_BITS, (lanes << ORDER1_BITS) + (lane << ORDER2_BITS)])
        self.states = np.array([lane << SURE_BITS, (lanes + lane) << SURE_BITS, (lanes << SURE_BITS + 1) + (lane << CLASS_BITS)])
        self.before = np.zeros(lanes, np.int64)
        self.cut(lanes)

    def cut(self, m: int) -> None:
        """Leaves the first ``m`` lanes."""
        for name in ("weights", "new", "base", "states", "before"):
            setattr(self, name, getattr(self, name)[..., :m].copy())
        self.state, self.p, self.hits = np.zeros((BATCH, 3, m), np.int64), np.zeros((BATCH, 3, m)), np.zeros((BATCH, 3, m))
        self.same, self.mixed, self.by = np.zeros((BATCH, m)), np.zeros((BATCH, m)), np.zeros((BATCH, m), np.int64)
        self.edges, self.told = np.zeros((BATCH, 5, m)), np.zeros((BATCH, 3, m))
        self.edges[:, 4] = ONE

    def places(self, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where both orders remember what follows ``ids``, and the hash the next step needs."""
        at = np.empty((*ids.shape[:-1], *self.base.shape), np.int64)
        one = np.multiply(ids, _HASH, out=at[..., 0, :])
        after = one * _HASH
        np.add(one, before if ids.ndim == 1 else np.concatenate((before[None], after[:-1])), out=at[..., 1, :])
        at >>= _SHIFTS
        at &= _MASKS
        at += self.base
        return at, after if ids.ndim == 1 else after[-1]

    def foretell(self, was: np.ndarray, sure: np.ndarray, ids: np.ndarray, a: int, b: int, shared: bool) -> np.ndarray:
        """Where the parts of ORDER2, ORDER1, SEEN and NEW begin, in 1 / ONE, for the steps from ``a`` to ``b`` of a batch."""
        low = was[:, 1] & _LOW
        low >>= _CLASS
        state, same, mixed, told, edges = self.state[a:b], self.same[a:b], self.mixed[a:b], self.told[a:b], self.edges[a:b]
        np.add(sure, self.states[:2], out=state[:, :2])
        np.add(low, self.states[2], out=state[:, 2])
        p = self.chance.take(state, mode="clip")
        self.p[a:b] = p
        np.equal(ids[:, 0], ids[:, 1], out=same)
        np.multiply(self.weights, p, out=told)
        told[:, 0] *= same
        np.add(told[:, 0], told[:, 1], out=mixed)
        mixed += told[:, 2]
        np.maximum(mixed, _FLOOR, out=mixed)
        np.minimum(mixed, _ROOM, out=mixed)
        wide2 = np.floor(mixed, out=edges[:, 1])
        known = np.subtract(_TOLD, wide2, out=told[:, 1])
        known *= p[:, 0]
        known *= np.subtract(_1, same, out=told[:, 2])
        known += wide2
        known += _FLOOR
        known = np.floor(known, out=edges[:, 2])
        if shared:
            wide = np.subtract(_LEAVE, known, out=told[:, 2])
            wide *= self.new
            np.subtract(_KEEP, wide, out=wide)
            np.ceil(wide, out=edges[:, 3])
        else:
            edges[:, 3] = known
        return edges

    def remember(self, at: np.ndarray, was: np.ndarray, sure: np.ndarray, hit: np.ndarray, marks: np.ndarray) -> None:
        kept = np.where(hit, (sure < _SURE).view(np.int8), _LESS)
        kept = was + kept
        stay = sure > _SOME
        stay |= hit
        self.held[at] = np.where(stay, kept, marks)

    def learn(self) -> None:
        """From a whole batch: ``hits`` of orders 1 and 2, and ``by`` what the ids came. Sums go step by step, as their
        order decides on the last bits."""
        hits, p = self.hits, self.p
        hits[:, 2] = hits[:, 1]
        error = hits[:, 1] * _STEP
        self.mixed *= _RATE
        error -= self.mixed
        hits -= p
        hits *= _RATE
        self.chance += np.bincount(self.state.reshape(-1), hits.reshape(-1), len(self.chance))
        p *= error[:, None]
        p[:, 0] *= self.same
        move = _TARGETS.take(self.by, mode="clip")
        move -= self.new
        move *= _NEW_RATES.take(self.by, mode="clip")
        for k in range(BATCH):
            self.weights += p[k]  # a weight moves with what its order foretold
            self.new += move[k]


def _phases(sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Ranges of steps between renewals, and the number of lanes with ids there. ``sizes`` fall."""
    ends = sorted({*sizes.tolist(), *filter(_renewals, range(int(sizes[0])))} - {0})
    for begin, end in zip([0, *ends], ends):
        yield begin, end, int(np.searchsorted(-sizes, -begin, "left"))


def _kind(size: int) -> type:
    if size > LIMIT:
        raise ValueError("too many ids")
    return np.uint16 if size <= ONE else np.uint32


def _totals(m: int, n: int, size: int) -> np.ndarray:
    """Into how many equal parts what tells an id is cut: one, the places of the shares, and all ids or, of a large
    vocabulary, their first digits."""
    return np.repeat(np.array([1.0, 1.0, max(n, 1), size if size <= ONE else -(-size // ONE)]), m)


def _whole(sizes: np.ndarray) -> np.ndarray:
    """Blocks are filled up to whole batches."""
    return -(-sizes // BATCH) * BATCH


def _encode(blocks: list[np.ndarray], size: int) -> list[bytes]:
    """Blocks of falling length."""
    sizes = _whole(np.array([len(b) for b in blocks]))
    lanes, steps = len(blocks), int(sizes[0])
    ids = np.zeros((steps, lanes), _kind(size))
    for i, b in enumerate(blocks):
        ids[: len(b), i], ids[len(b) :, i] = b, b[-1]
    model, shares = Model(lanes), Shares()
    low, span, ends = np.zeros(lanes), np.full(lanes, TOP), np.zeros(lanes)
    large = size > ONE  # a new id is told in two digits
    out: list[list[np.ndarray]] = [[] for _ in blocks]
    grows = np.array([1.0, WORD])

    def send(row: int) -> None:
        short = np.less(span, _WORD, out=sent[row])
        word = low * _PER_WORD
        np.floor(word, out=word)
        words[row] = word
        word *= short
        word *= _WORD
        np.subtract(low, word, out=low)
        grow = grows.take(short, mode="clip")
        np.multiply(low, grow, out=low)
        np.multiply(span, grow, out=span)

    at = model.base
    for begin, end, m in _phases(sizes):
        if m < len(low):
            ends[m : len(low)] = low[m:]
            low, span, at = low[:m].copy(), span[:m].copy(), at[:, :m].copy()
            model.cut(m)
        if _renewals(begin):
            shares.renew(m, ids, begin)
        now = ids[begin:end, :m].astype(np.int32)
        runs = np.ascontiguousarray(shares.of(ids[begin:end, :m].T, size).T) if shares.n else np.zeros_like(now)
        totals, lane = _totals(m, shares.n, size), np.arange(m) + np.arange(BATCH)[:, None] * (5 * m)
        words, sent = np.zeros((end - begin << large, m), np.uint32), np.zeros((end - begin << large, m), bool)
        was, sure, old = np.zeros((3, BATCH, 2, m), np.int32)
        hits, by, hit_floats = np.zeros((BATCH, 2, m), bool), model.by, model.hits
        for a in range(0, end - begin, BATCH):
            own, run = now[a : a + BATCH], runs[a : a + BATCH]
            first, length = run >> 16, run & ONE - 1
            marks, new = _marks(own, length), length == 0
            np.copyto(first, own >> 16 if large else own, where=new)
            length += new
            nexts, model.before = model.places(own, model.before)
            for j in range(BATCH):
                held = model.held.take(at, mode="clip")
                was[j] = held
                confident = np.bitwise_and(held, _SURE, out=sure[j])
                hit = np.equal(np.right_shift(held, _ID, out=old[j]), own[j], out=hits[j])
                told = held - confident
                mark = np.where(hit[0], told[0], marks[j])
                model.remember(at, held, confident, hit, np.where(hit[1], told[1], mark))
                at = nexts[j]
            edges = model.foretell(was, sure, old, 0, BATCH, shares.n > 0).reshape(-1)
            hit_floats[:, :2] = hits
            by[:] = new
            by += SEEN
            by[hits[:, 0]] = ORDER1
            by[hits[:, 1]] = ORDER2
            which = by * m
            total = totals.take(which + lane[0], mode="clip")
            which += lane
            start = edges.take(which, mode="clip")
            width = edges[m:].take(which, mode="clip")
            width -= start
            other = by > ORDER1
            place = first * other
            length *= other
            count = np.maximum(length, 1).astype(np.float64)
            for j in range(BATCH):
                unit = span * _UNIT
                np.floor(unit, out=unit)
                low += start[j] * unit
                unit *= width[j]
                unit /= total[j]
                np.floor(unit, out=unit)
                low += unit * place[j]
                np.multiply(unit, count[j], out=span)
                send(a + j << large)
                if large:
                    some = by[j] == NEW
                    unit = np.floor(span[some] * _UNIT)
                    low[some] += (own[j, some] & ONE - 1) * unit
                    span[some] = unit
                    send(2 * (a + j) + 1)
            model.learn()
        flat, each = words.T[sent.T], sent.sum(0)
        for lane_out, a, b in zip(out, (np.cumsum(each) - each).tolist(), np.cumsum(each).tolist()):
            lane_out.append(flat[a:b])
    ends[: len(low)] = low
    return [_bytes(np.concatenate([*x, [last]]).astype(np.uint32)) for x, last in zip(out, np.ceil(ends * _PER_WORD))]


def _bytes(words: np.ndarray) -> bytes:
    """The words of a lane, of which the last one ends in its last interval, once carries are brought to the words before."""
    while (carry := words >> WORD_BITS).any():
        words &= (1 << WORD_BITS) - 1
        words[:-1] += carry[1:]
    return words.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()


def _decode(blocks: list[bytes], sizes: np.ndarray, size: int) -> list[np.ndarray]:
    counts, sizes = sizes.tolist(), _whole(sizes)
    lanes, steps = len(blocks), int(sizes[0])
    ids = np.zeros((steps, lanes), _kind(size))
    model, shares = Model(lanes), Shares()
    room = -(-max(map(len, blocks)) // 3) + 3
    data = np.zeros((lanes, room, 4), np.uint8)
    for i, block in enumerate(blocks):
        some = np.frombuffer(block + bytes(-len(block) % 3), np.uint8).reshape(-1, 3)
        data[i, : len(some), 1:] = some
    data = data.reshape(-1).view(">u4").astype(np.int64)
    next_word = np.arange(lanes) * room
    # ``code`` is how far the stream lies above the low end of the range.
    code, span = data[next_word] * WORD + data[next_word + 1], np.full(lanes, TOP)
    next_word += 2
    large = size > ONE  # a new id is told in two digits
    grows = np.array([1.0, WORD])

    def fetch() -> None:
        short = (span < _WORD).astype(np.int64)
        grow = grows.take(short, mode="clip")
        np.multiply(span, grow, out=span)
        np.multiply(code, grow, out=code)
        word = data.take(next_word, mode="clip")  # a damaged block may ask for more than there is
        word *= short
        np.add(code, word, out=code)
        np.add(next_word, short, out=next_word)

    runs, at = np.zeros(1, np.int64), model.base
    for begin, end, m in _phases(sizes):
        if m < len(code):
            next_word, code, span, at = next_word[:m].copy(), code[:m].copy(), span[:m].copy(), at[:, :m].copy()
            model.cut(m)
        if _renewals(begin):
            shares.renew(m, ids, begin)
            del runs
            runs = shares.places()
        lane, totals = np.arange(m), _totals(m, shares.n, size)
        lasts, base, bits = totals - 1, lane * shares.n, np.array(ONE - 1)
        # By what tells an id: its mark, and the first place and the length of its run.
        marks, firsts, lengths = np.zeros((4, m), np.int64), np.zeros((4, m), np.int64), np.ones((4, m), np.int64)
        edges = np.zeros((5, m))
        for step in range(begin, end):
            unit = span * _UNIT
            np.floor(unit, out=unit)
            j = step % BATCH
            was = model.held.take(at, mode="clip")
            old, sure = was >> _ID, was & _SURE
            np.multiply(model.foretell(was[None], sure[None], old[None], j, j + 1, shares.n > 0)[0], unit, out=edges)
            above = (code >= edges[1:4]).view(np.int8)
            above[0] += above[1]
            above[0] += above[2]
            by = model.by[j]
            by[:] = above[0]
            which = by * m
            which += lane
            start = edges.take(which, mode="clip")
            width = edges[1:].take(which, mode="clip")
            width -= start
            width /= totals.take(which, mode="clip")
            np.floor(width, out=width)
            np.subtract(code, start, out=code)
            place = code / width
            np.minimum(place, lasts.take(which, mode="clip"), out=place)
            place = place.astype(np.int64)
            firsts[NEW] = place
            np.left_shift(place, _ID, out=marks[NEW])
            place += base
            run = runs.take(place, mode="clip")
            np.right_shift(run, 32, out=marks[SEEN])
            np.bitwise_and(run, bits, out=lengths[SEEN])
            run >>= 16
            np.bitwise_and(run, bits, out=firsts[SEEN])
            marks[:2] = (was - sure)[::-1]
            mark = marks.take(which, mode="clip").astype(np.int32)
            np.multiply(width, lengths.take(which, mode="clip"), out=span)
            width *= firsts.take(which, mode="clip")
            np.subtract(code, width, out=code)
            np.minimum(code, span - 1, out=code)  # of a damaged block, it may lie beyond
            fetch()
            if large:
                some = by == NEW
                unit = np.floor(span[some] * _UNIT)
                digit = np.minimum(np.floor(code[some] / unit), ONE - 1)
                code[some] = np.minimum(code[some] - digit * unit, unit - 1)
                span[some] = unit
                mark[some] = np.minimum((mark[some] << 16) + (digit.astype(np.int32) << ID_SHIFT), size - 1 << ID_SHIFT)
                fetch()
            now = mark >> _ID
            ids[step, :m] = now
            hit = old == now
            model.hits[j, :2] = hit
            model.remember(at, was, sure, hit, mark)
            at, model.before = model.places(now, model.before)
            if j == BATCH - 1:
                model.learn()
    whole = np.ascontiguousarray(ids.T)
    return [whole[i, :n].astype(np.uint32) for i, n in enumerate(counts)]


def groups(n: int) -> list[tuple[int, int]]:
    """Even ranges of at most LANES blocks."""
    count = -(-n // LANES)
    return [(i * n // count, (i + 1) * n // count) for i in range(count)]


HEAD = np.dtype([("magic", "S4"), ("ids", "<u4"), ("size", "<u4"), ("crc", "<u4")])
MAGIC = b"RVB2"


def encode_stream(ids: np.ndarray, size: int, block_ids: int = BLOCK_IDS) -> list[bytes]:
    """Blocks of ``block_ids`` ids below ``size``, each with a head: mark, number of ids, vocabulary, checksum."""
    cut = [ids[a : a + block_ids] for a in range(0, len(ids), block_ids)]
    out = []
    for a, b in groups(len(cut)):
        part = cut[a:b]
        for block, data in zip(part, _encode(part, size)):
            head = np.array([(MAGIC, len(block), size, zlib.crc32(block.astype("<u4").tobytes()))], HEAD)
            out.append(head.tobytes() + data)
    return out


def decode_stream(blocks: list[bytes]) -> np.ndarray:
    """The ids of all blocks; a block whose mark or checksum is wrong raises ValueError."""
    heads = [np.frombuffer(b[: HEAD.itemsize], HEAD)[0] if len(b) >= HEAD.itemsize else None for b in blocks]
    if any(h is None or h["magic"] != MAGIC for h in heads):
        raise ValueError("not a block of ids")
    out: list = [np.zeros(0, np.uint32)] * len(blocks)
    for size in {int(h["size"]) for h in heads}:
        order = sorted((i for i, h in enumerate(heads) if h["size"] == size), key=lambda i: -int(heads[i]["ids"]))
        for a, b in groups(len(order)):
            part = order[a:b]
            sizes = np.array([int(heads[i]["ids"]) for i in part])
            for i, got in zip(part, _decode([blocks[i][HEAD.itemsize :] for i in part], sizes, size)):
                if zlib.crc32(got.astype("<u4").tobytes()) != heads[i]["crc"]:
                    raise ValueError("a block of ids is damaged")
                out[i] = got
    return np.concatenate([np.zeros(0, np.uint32), *out])


_KINDS = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
_KINDS_SQL = "part long, kind int, place long, doc_id long, n_tokens long, data binary"
DOC, BLOCK = 0, 1
PART_BYTES = 24 << 20  # text of a part, and so of a task
LONG_WORD = 1_000  # characters


def _settled_letters() -> str:
    """A class of the characters that Unicode has called letter, number, space or neither from early on, so that all
    libraries cut texts between the same ones."""
    kind = lambda name: name[0] if name[0] in "LNZ" else ""
    then, now = unicodedata.ucd_3_2_0.category, unicodedata.category
    kept = [c for c in map(chr, range(1, 0xD800)) if then(c) != "Cn" and kind(then(c)) == kind(now(c))]
    out, begin = [], kept[0]
    for a, b in zip(kept, [*kept[1:], "\0"]):
        if ord(b) != ord(a) + 1:
            out.append(f"{re.escape(begin)}-{re.escape(a)}")
            begin = b
    return "".join(out)


class CachedTokenizer:
    """The tokenizers library on parts of texts: a single space before other text always begins a new piece of this
    byte-level family, so what lies between such spaces is encoded once per call. Where merges come in the order of
    their ranks and every token is what its own letters merge to, merging by the rank of the joint bytes gives the
    same ids, which tiktoken does faster; odd words are left to the library."""

    def __init__(self, packed: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already fill the cores
        spec = json.loads(zlib.decompress(packed))
        self.inner = Tokenizer.from_str(zlib.decompress(packed).decode())
        self.inner.no_truncation()
        self.inner.no_padding()
        before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.whole = before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") is not None
        self.whole = bool(self.whole or any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added))
        self.size = self.inner.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.size <= ONE else np.uint32
        self.fast = None if self.whole or before.get("use_regex") is False else self._by_rank(spec, {t["content"] for t in added})
        if self.fast:
            self.odd = re.compile("|".join([f"[^{_settled_letters()}]", *(re.escape(t["content"]) for t in added)]))

    def _by_rank(self, spec: dict, added: set[str]) -> tiktoken.Encoding | None:
        model, letters = spec["model"], byte_letters()
        vocab = {name: i for name, i in model["vocab"].items() if name not in added}
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        order = [*letters, *joined]
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        if len(set(order)) != len(order) or set(order) != set(vocab) or any([t.id for t in self.inner.model.tokenize(name)] != [i] for name, i in vocab.items()):
            return None
        self.ids = np.array([vocab[name] for name in order], self.kind)
        self.lengths = np.array([len(name) for name in order])
        pieces = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        return tiktoken.Encoding("ranks", pat_str=pieces, mergeable_ranks={bytes(letters[c] for c in name): i for i, name in enumerate(order)}, special_tokens={})

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word after a space, in a row, and how many each has."""
        n = len(words)
        if self.fast and n:
            joined = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), words), pa.scalar(" ", words.type))[0].as_py()
            sizes = np.asarray(pc.binary_length(words))
            odd = self.odd.search(joined) is not None or sizes.max() > LONG_WORD
            if not odd:
                ranks = self.fast.encode_to_numpy(joined, allowed_special=set(), disallowed_special=())
                at = np.searchsorted(np.cumsum(self.lengths[ranks]), np.cumsum(sizes + 1), "left") + 1
                return self.ids[ranks], np.diff(at, prepend=0)
            odd = np.array([len(w) > LONG_WORD or self.odd.search(w) is not None for w in words.to_pylist()]) | (sizes > LONG_WORD)
            if not odd.all():  # the odd ones by themselves
                (flat, counts), (more, others) = (self._words(words.filter(pa.array(x))) for x in (~odd, odd))
                order = np.argsort(odd, kind="stable")
                each, counts = np.concatenate([counts, others]), np.empty(n, np.int64)
                begins = np.empty(n, np.int64)
                counts[order], begins[order] = each, np.cumsum(each) - each
                return _gathered(np.concatenate([flat, more]), begins, counts), counts
        ids = self._batch([" " + w for w in words.to_pylist()])
        return np.fromiter(chain.from_iterable(ids), self.kind), np.fromiter(map(len, ids), np.int64, n)

    def encode(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with those of ``end`` behind, and how many each text has with them."""
        n = len(texts)
        if self.whole:
            ids = [[*x, *end] for x in self._batch(texts.to_pylist())]
            return np.fromiter(chain.from_iterable(ids), self.kind), np.fromiter(map(len, ids), np.int64, n)
        parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
        words, codes, cuts = _coded(parts)
        odd = pc.match_substring_regex(words, r"^([\pZ\s\x0b\x1c-\x1f\x{85}]|$)")
        if pc.any(odd).as_py():  # white space after a space: these texts are cut elsewhere
            of = np.repeat(np.arange(n), cuts - 1)
            wrong = set(np.unique(of[np.asarray(odd)[codes]]).tolist())
            parts = pa.array([cut(x) if i in wrong else x.split(" ") for i, x in enumerate(texts.to_pylist())], pa.large_list(pa.large_string()))
            words, codes, cuts = _coded(parts)
        flat, counts = self._words(words)
        heads = self._batch(parts.flatten().take(pa.array(np.cumsum(cuts) - cuts)).to_pylist())
        # Every text is its first word, the others and the end; these are numbered behind the words.
        order, ends = np.empty(len(codes) + 2 * n, np.int32), np.cumsum(cuts + 1)
        rest = np.ones(len(order), bool)
        rest[ends - cuts - 1] = rest[ends - 1] = False
        order[rest], order[ends - cuts - 1], order[ends - 1] = codes, len(words) + np.arange(n), len(words) + n
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(heads), self.kind), np.array(end, self.kind)])
        counts = np.concatenate([counts, np.fromiter(map(len, heads), np.int64, n), [len(end)]])
        sizes = counts[order]
        return _gathered(flat, (np.cumsum(counts) - counts)[order], sizes), np.diff(np.cumsum(sizes)[ends - 1], prepend=0)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        ids, sizes = self.encode(pa.array(texts, pa.string()), [])
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


def _coded(parts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of lists of words but for each one's first, their numbers in a row, and the lists' lengths."""
    offsets = np.asarray(parts.offsets)
    rest = np.ones(offsets[-1], bool)
    rest[offsets[:-1]] = False
    coded = parts.flatten().filter(pa.array(rest)).dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), np.diff(offsets)


def _gathered(flat: np.ndarray, begins: np.ndarray, counts: np.ndarray, some: int = 1 << 16) -> np.ndarray:
    """The pieces of ``flat`` that begin there and have so many elements."""
    out = [flat[:0]]
    for a in range(0, len(counts), some):
        count = counts[a : a + some]
        ends = np.cumsum(count)
        out.append(flat[np.repeat(begins[a : a + some] - ends + count, count) + np.arange(ends[-1])])
    return np.concatenate(out)


def worker_tokenizer(packed: bytes) -> CachedTokenizer:
    """The tokenizer a worker process keeps between its tasks. It lies with the interpreter, as functions travel by value."""
    kept, key = vars(sys).setdefault("_ravelin_tokenizers", {}), hashlib.sha256(packed).digest()
    if key not in kept:
        kept.clear()
        kept[key] = CachedTokenizer(packed)
    return kept[key]


def write_ids(docs: DataFrame, packed: bytes, path: str, end_id: int = 0, part_bytes: int = PART_BYTES) -> None:
    """Writes the ids of all texts, each followed by ``end_id``, in ascending (doc_id, text) order, nulls first: per
    part one row for each document (its place and number of ids) and one for each coded block. Null texts are empty;
    repeated rows are written each."""
    rows = text_rows(docs)
    parts = block_count(rows, part_bytes)
    # Texts are sampled for the ranges by how they begin, so that few bytes meet in the driver.
    ordered = rows.repartitionByRange(parts, "doc_id", F.substring("text", 1, 256)).sortWithinPartitions("doc_id", "text")

    def pieces(batches):
        """Rows of about a part's text; a part is seldom much larger."""
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                held.append(some := batch.slice(at, 200))
                size += pc.sum(pc.binary_length(some.column("text"))).as_py() or 0
                if size >= PART_BYTES:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        tokens, part, place, block = worker_tokenizer(packed), TaskContext.get().partitionId(), 0, 0
        whole = 2 * LANES * BLOCK_IDS  # a very large part is coded piece by piece
        held = np.zeros(0, tokens.kind)
        for some in pieces(batches):
            ids, sizes = tokens.encode(some["text"].combine_chunks(), [end_id])
            pa.default_memory_pool().release_unused()
            n = len(sizes)
            yield from pa.table([pa.array([part] * n, pa.int64()), pa.array([DOC] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), some["doc_id"], pa.array(sizes), pa.nulls(n, pa.binary())], schema=_KINDS).to_batches()
            place += n
            held = np.concatenate([held, ids])
            while len(held) >= whole:
                yield blocks(part, block, encode_stream(held[:whole], tokens.size))
                block, held = block + 2 * LANES, held[whole:]
        if len(held):
            yield blocks(part, block, encode_stream(held, tokens.size))

    def blocks(part: int, first: int, coded: list[bytes]) -> pa.RecordBatch:
        n = len(coded)
        return pa.record_batch([pa.array([part] * n, pa.int64()), pa.array([BLOCK] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(coded, pa.binary())], schema=_KINDS)

    ordered.mapInArrow(run, _KINDS_SQL).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``
    and ``ids`` as little-endian unsigned 32-bit numbers. A part is decoded by one task; parts are bounded when they
    are written, and only their sizes meet for the starts. A damaged block is an error."""
    stored = spark.read.schema(_KINDS_SQL).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sizes = stored.filter(F.col("kind") == DOC).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = sizes.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "ascending"), ("place", "ascending")])
        is_doc = np.asarray(table["kind"]) == DOC
        docs = table.filter(pa.array(is_doc))
        ids = decode_stream(table.filter(pa.array(~is_doc))["data"].to_pylist()).astype("<u4")
        counts = np.asarray(docs["n_tokens"])
        ends = np.cumsum(counts)
        if docs.num_rows and ends[-1] != len(ids):
            raise ValueError("the blocks of a part are not complete")
        pieces = [ids[e - n : e].tobytes() for n, e in zip(counts.tolist(), ends.tolist())]
        return pa.table([docs["part"], docs["doc_id"], pa.array(ends - counts), docs["n_tokens"], pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array(pieces, pa.binary())], schema=schema)

    read = stored.groupBy("part").applyInArrow(run, "part long, doc_id long, offset long, n_tokens long, ids_crc32 long, ids binary")
    return read.join(bases, F.col("part") == F.col("of")).select("doc_id", (F.col("offset") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "ids")
