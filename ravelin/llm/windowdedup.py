"""Substring dedup behind a count-min prefilter.

Texts are dealt into blocks by their digest, so copies of one text meet and count once. Each block sketches the
hashes of its word windows: two rows of cells, stored sparsely as the sorted cells in use. The sketches are merged
by ranges of cells, and each block gets back one bit per cell it used: whether the merged count is above one. Only
windows with both bits set are grouped exactly, by 128-bit hashes and again by ranges; a block sends its first
occurrence per window and learns whether an earlier one exists elsewhere. The sketches overestimate, so no repeated
window is lost; their width follows the data, so that few others pass. Nothing is broadcast or collected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import text_rows

WINDOW = 20
BLOCK_BYTES = 8 << 20  # text per block, and so per task
FLUSH_BYTES = 16 << 20  # text a task gathers before it sends its blocks on
SPARE_BITS = 4  # cells per possible window, as a power of two
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: after all others

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_STEPS = [np.uint64(x) for x in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; widths must be known to the reader."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return len(arrays[0]).to_bytes(8, "little") + _zip(b"".join(planes))


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    n, widths = int.from_bytes(data[:8], "little"), [np.dtype(k).itemsize for k in kinds]
    raw, out, at = _unzip(data[8:], n * sum(widths)), [], 0
    for kind, width in zip(kinds, widths):
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n) if n else np.zeros((width, 0), np.uint8)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return out


def _zip(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _unzip(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True) if size else b""


def pack_rows(rows: list[tuple]) -> bytes:
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "key": pa.array([r[1] for r in rows], pa.binary()), "text": pa.array([r[2] for r in rows], pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def combine(parts: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """One row per text digest and part of a task, with the smallest doc_id, packed by block."""
    held: dict[bytes, list] = {}
    size = 0

    def flush():
        dealt: dict[int, list] = {}
        for key, (doc_id, text) in held.items():
            dealt.setdefault(int.from_bytes(key[:8], "big") % blocks, []).append((doc_id, key, text))
        if dealt:
            yield pa.record_batch([pa.array(list(dealt), pa.int64()), pa.array([pack_rows(r) for r in dealt.values()], pa.binary())], names=["block", "data"])

    for part in parts:
        for doc_id, key, text in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), part.column("text")):
            doc_id = LAST if doc_id is None else doc_id
            if key in held:
                held[key][0] = min(held[key][0], doc_id)
                continue
            data = text.as_py().encode("utf-8", "surrogatepass")
            held[key] = [doc_id, data]
            size += len(data) + 100
            if size > FLUSH_BYTES:
                yield from flush()
                held, size = {}, 0
    yield from flush()


class Block:
    """The distinct texts of one block in order, with the hashes of their windows."""

    def __init__(self, packed: list[bytes], window: int) -> None:
        first: dict[bytes, list] = {}
        for data in packed:
            table = pa.ipc.open_stream(data).read_all()
            for doc_id, key, text in zip(table["doc_id"].to_pylist(), table["key"].to_pylist(), table["text"]):
                if key in first:
                    first[key][0] = min(first[key][0], doc_id)
                else:
                    first[key] = [doc_id, text]
        self.rows = sorted(((d, k, t) for k, (d, t) in first.items()), key=lambda r: r[:2])
        known: dict[bytes, int] = {}
        put, ids = known.setdefault, []
        for _, _, text in self.rows:
            words = text.as_py().split()
            ids.append(np.fromiter((put(w, len(known)) for w in words), np.int32, len(words)))
        self.n_words = np.array([len(x) for x in ids], np.int64)
        self.ends = np.cumsum(self.n_words)
        hashes = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in known), np.uint64).reshape(-1, 2)
        del known
        all_ids = np.concatenate([*ids, np.zeros(0, np.int32)])
        windows = np.maximum(self.n_words - window + 1, 0)
        total = int(windows.sum())
        self.doc = np.repeat(np.arange(len(self.rows)), windows)  # of each window
        self.start = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
        self.at = self.start + np.repeat(self.ends - self.n_words, windows)  # of each window, among the block's words
        self.hashes = [self._rolled(hashes[:, r][all_ids], window, r)[self.at] for r in (0, 1)] if total else [np.zeros(0, np.uint64)] * 2

    @staticmethod
    def _rolled(words: np.ndarray, window: int, row: int) -> np.ndarray:
        n = len(words) - window + 1
        out = np.zeros(n, np.uint64)
        for j in range(window):
            out *= _STEPS[row]
            out += words[j : j + n]
        out ^= out >> np.uint64(30)
        out *= _MIX[1]
        out ^= out >> np.uint64(27)
        out *= _MIX[2]
        out ^= out >> np.uint64(31)
        return out

    def doc_ids(self) -> np.ndarray:
        return np.array([r[0] for r in self.rows], np.int64)


def ranges(values: np.ndarray, bits: int, slices: int) -> np.ndarray:
    """Borders of ``slices`` even ranges of ``bits``-bit values within the sorted ``values``."""
    borders = np.array([(i << bits) // slices for i in range(1, slices)], np.uint64)
    return np.concatenate(([0], np.searchsorted(values, borders), [len(values)])).astype(np.int64)


def cells(block: Block, bits: int, row: int):
    """Sorted cells in use, each window's place among them and whether a cell is used twice or more."""
    used, place, count = np.unique(block.hashes[row] >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
    return used, place.reshape(-1), count > 1


_SKETCH = pa.schema([("slice", pa.int64()), ("block", pa.int64()), ("row", pa.int32()), ("data", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("part", pa.int64()), ("data", pa.binary())])
_PASS = 2  # the row number of what a block sends to itself
_SKETCH_SQL = "slice long, block long, row int, data binary"
_ANSWER_SQL = "block long, row int, part long, data binary"


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def sketch(block_no: int, block: Block, bits: int, slices: int) -> list[tuple]:
    out = []
    for row in (0, 1):
        used, _, twice = cells(block, bits, row)
        cut = ranges(used, bits, slices)
        for s in range(slices):
            a, b = int(cut[s]), int(cut[s + 1])
            if b > a:
                steps = np.diff(used[a:b], prepend=np.uint64((s << bits) // slices))
                out.append((row * slices + s, block_no, row, pack(steps, twice[a:b].view(np.uint8))))
    return out


def merge_sketches(table: pa.Table) -> pa.Table:
    """The sum of all blocks' sketches over one range of cells; one bit per cell sent: is the sum above one?"""
    parts = [unpack(d.as_py(), np.uint64, np.uint8) for d in table["data"]]
    values = np.concatenate([np.cumsum(p[0]) for p in parts])
    counts = np.concatenate([p[1] for p in parts]) + np.uint8(1)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(fresh))
    above = np.empty(len(values), bool)
    above[order] = (sums > 1)[np.cumsum(fresh) - 1]
    return _answers(table, [len(p[0]) for p in parts], above)


def _answers(table: pa.Table, sizes: list[int], bits: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    rows = [
        (block, row, part, pack(np.packbits(bits[e - n : e])))
        for block, row, part, n, e in zip(table["block"].to_pylist(), table["row"].to_pylist(), table["slice"].to_pylist(), sizes, ends)
    ]
    return _rows(_ANSWER, rows)


def _bits(answers: dict, row: int, cut: np.ndarray, offset: int) -> np.ndarray:
    out = [np.zeros(0, bool)]
    for s in range(len(cut) - 1):
        n = int(cut[s + 1] - cut[s])
        if n:
            out.append(np.unpackbits(unpack(answers[row, offset + s], np.uint8)[0], count=n).astype(bool))
    return np.concatenate(out)


def likely(block: Block, answers: dict, bits: int, slices: int) -> np.ndarray:
    """Windows whose estimated count, the least of both rows, is above one."""
    out = np.ones(len(block.at), bool)
    for row in (0, 1):
        used, place, _ = cells(block, bits, row)
        out &= _bits(answers, row, ranges(used, bits, slices), row * slices)[place]
    return out


def first_in_block(block: Block, chosen: np.ndarray):
    """The chosen windows ordered by content and place; the group of each and the groups' first ones."""
    doc_ids = block.doc_ids()[block.doc[chosen]]
    a, b, start = block.hashes[0][chosen], block.hashes[1][chosen], block.start[chosen]
    order = np.lexsort((start, doc_ids, b, a))
    a, b = a[order], b[order]
    fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    return order, np.cumsum(fresh) - 1, heads, a[heads], b[heads], doc_ids[order], start[order]


def exact_parts(block_no: int, block: Block, chosen: np.ndarray, slices: int) -> list[tuple]:
    _, _, heads, a, b, doc_ids, start = first_in_block(block, chosen)
    cut = ranges(a, 64, slices)
    out = []
    for s in range(slices):
        x, y = int(cut[s]), int(cut[s + 1])
        if y > x:
            out.append((s, block_no, 0, pack(a[x:y], b[x:y], doc_ids[heads[x:y]], start[heads[x:y]].astype(np.int32))))
    mask = np.zeros(len(block.at), bool)
    mask[chosen] = True
    out.append((block_no % slices, block_no, _PASS, pack(np.packbits(mask))))
    return out


def group_exactly(table: pa.Table) -> pa.Table:
    """All blocks' first occurrences over one range of hashes; one bit each: is there an earlier one?"""
    own = [r == _PASS for r in table["row"].to_pylist()]
    passed = table.filter(pa.array(own))
    back = _rows(_ANSWER, [(b, _PASS, 0, d) for b, d in zip(passed["block"].to_pylist(), passed["data"].to_pylist())])
    rest = table.filter(pa.array([not x for x in own]))
    if not rest.num_rows:
        return back
    parts = [unpack(d.as_py(), np.uint64, np.uint64, np.int64, np.int32) for d in rest["data"]]
    a, b, doc_ids, start = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, doc_ids, b, a))
    a, b = a[order], b[order]
    fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    later = np.empty(len(a), bool)
    later[order] = (doc_ids[order] != doc_ids[order][head]) | (start[order] != start[order][head])
    return pa.concat_tables([back, _answers(rest, [len(p[0]) for p in parts], later)])


_CLASSES = pa.schema([("key", pa.binary()), ("first_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def strip(block: Block, answers: dict, window: int, slices: int) -> pa.Table:
    """Words left in each text of the block, joined by one space."""
    chosen = np.flatnonzero(np.unpackbits(unpack(answers[_PASS, 0], np.uint8)[0], count=len(block.at)).astype(bool))
    order, group, heads, a, _, doc_ids, start = first_in_block(block, chosen)
    later = _bits(answers, 0, ranges(a, 64, slices), 0)[group] if len(chosen) else np.zeros(0, bool)
    head = heads[group]
    later = later | (doc_ids != doc_ids[head]) | (start != start[head])
    at = block.at[chosen[order[later]]]
    edge = np.zeros(int(block.n_words.sum()) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    gone = np.cumsum(edge)[:-1] > 0
    rows = []
    for (doc_id, key, text), n, end in zip(block.rows, block.n_words.tolist(), block.ends.tolist()):
        words, lost = text.as_py().split(), gone[end - n : end]
        n_lost = int(lost.sum())
        if n_lost:
            words = [words[i] for i in np.flatnonzero(~lost)]
        rows.append((key, None if doc_id == LAST else doc_id, n, n_lost, b" ".join(words).decode("utf-8", "surrogatepass")))
    return _rows(_CLASSES, rows)


def text_key(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def strip_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per distinct text: its ``key`` (digest of the text), the smallest doc_id that has it, ``n_words``,
    ``n_removed`` and ``kept``, the words left. Judges windows by (doc_id, start); a null doc_id comes last, and
    windows at the same doc_id and start count as one. Null texts are empty."""
    rows = text_rows(docs).withColumn("key", text_key(F.col("text")))
    total = int(rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0)
    blocks = max(1, -(-total // block_bytes))
    slices = max(1, blocks)
    bits = min(56, max(16, math.ceil(math.log2(total + 2)) - 2 + SPARE_BITS))

    def run_combine(parts):
        return combine(parts, blocks)

    dealt = rows.mapInArrow(run_combine, "block long, data binary")

    def block_of(table: pa.Table) -> Block:
        return Block([d.as_py() for d in table["data"]], window)

    def answers_of(table: pa.Table) -> dict:
        return {(r, p): d for r, p, d in zip(table["row"].to_pylist(), table["part"].to_pylist(), table["data"].to_pylist())}

    def run_sketch(key, table):
        return _rows(_SKETCH, sketch(key[0].as_py(), block_of(table), bits, slices))

    def run_likely(key, left, right):
        block = block_of(left)
        return _rows(_SKETCH, exact_parts(key[0].as_py(), block, np.flatnonzero(likely(block, answers_of(right), bits, slices)), slices))

    def run_strip(key, left, right):
        return strip(block_of(left), answers_of(right), window, slices)

    sketches = dealt.groupBy("block").applyInArrow(run_sketch, _SKETCH_SQL)
    counted = sketches.groupBy("slice").applyInArrow(merge_sketches, _ANSWER_SQL)
    parts = dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(run_likely, _SKETCH_SQL)
    grouped = parts.groupBy("slice").applyInArrow(group_exactly, _ANSWER_SQL)
    return dealt.groupBy("block").cogroup(grouped.groupBy("block")).applyInArrow(run_strip, "key binary, first_id long, n_words long, n_removed long, kept string")


def judged(rows: DataFrame, classes: DataFrame, window: int = WINDOW, *extra: str) -> DataFrame:
    """``rows`` (with ``key`` and ``doc_id``) with the verdict of their text: a later copy loses all its words, if
    they fill a window. ``classes`` has one row per key, so no row is multiplied, and a busy key can be split.
    Adds ``is_first``, ``n_words``, ``n_removed`` and the ``extra`` columns of ``classes``."""
    right = classes.select(F.col("key").alias("class_key"), "first_id", F.col("n_words").alias("class_words"), F.col("n_removed").alias("class_removed"), *extra)
    joined = rows.join(right, F.col("key") == F.col("class_key"), "left")
    first = F.col("doc_id").eqNullSafe(F.col("first_id"))
    removed = F.when(first | (F.col("class_words") < window), F.col("class_removed")).otherwise(F.col("class_words"))
    return joined.select(*(rows[c] for c in rows.columns if c != "key"), first.alias("is_first"), F.col("class_words").alias("n_words"), removed.alias("n_removed"), *extra)


def removal_digests(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and the digest of the kept words per row of ``docs``."""
    classes = strip_repeats(docs, window, block_bytes).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    out = judged(rows, classes, window, "kept_sha256")
    gone = F.col("n_removed") == F.col("n_words")
    return out.select("doc_id", "n_words", "n_removed", F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
