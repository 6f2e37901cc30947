"""Benchmark decontamination by winnowing.

Every window of WINDOW words chooses the least hash of the PRINT-word sequences within it, the rightmost of equal ones,
as its fingerprint. Two texts that share a window choose the same fingerprint from it, so a shared span of a whole
window is never missed. An item shorter than a window is one window of its own length, and documents are winnowed once
more for each such length that occurs (WINDOW - 1 at most). Documents and items are joined on fingerprints; a hit is
extended to the windows that chose it, which the join compares by a 128-bit digest of all their words, so a fingerprint
that is common pairs with equal windows only and never with all its occurrences. A table of the items' fingerprints,
one bit per cell and bounded in size, lets most fingerprints of documents go before the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import WORD_CACHE, gather_parts, materialise, split_words, table_parts
from ravelin.operators.enrich import lookup_side

WINDOW = 10
PRINT = 5  # words of a fingerprint
GROUP_BYTES = 4 << 20  # text a task looks at together
SLAB = 1 << 18  # windows hashed at once
SEGMENT = 1 << 16  # words of a document whose hits are counted together
CELL_BITS = (12, 27)  # least and greatest size of the table of fingerprints, as powers of two
SPARE_BITS = 5
BROADCAST_WINDOWS = 200_000  # distinct item windows above which the join shuffles instead

#: What separates words: ASCII but digits and letters; A-Z becomes a-z.
_PLAIN = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_STEPS = [np.uint64(x) for x in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)]


class Lexicon(dict):
    """Numbers of words, and two 64-bit hashes of each."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.digests.append(hashlib.blake2b(word, digest_size=16).digest())
        return number

    def __init__(self) -> None:
        self.digests: list[bytes] = []

    def forget(self) -> None:
        self.clear()
        self.digests.clear()

    def lanes(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.digests), np.uint64).reshape(-1, 2)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(words: np.ndarray, size: int, lane: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs of ``size`` words from every place, or from the places named."""
    out = np.full(len(words) - size + 1 if starts is None else len(starts), size, np.uint64)
    for j in range(size):
        out *= _STEPS[lane]
        out += words[j : j + len(out)] if starts is None else words[starts + j]
    return mixed(out)


def chosen(words: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each window of ``size`` words: the least hash, the rightmost of equal ones."""
    grams = rolled(words, min(PRINT, size), 0)
    n = len(words) - size + 1
    best = grams[:n].copy()
    for j in range(1, size - min(PRINT, size) + 1):
        np.minimum(best, grams[j : j + n], out=best)
    return best


def prints(words: np.ndarray, ends: np.ndarray, size: int, cells: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Windows of ``size`` words within the texts that end at ``ends``: their text, start, fingerprint and two-part
    digest. With ``cells`` only windows whose fingerprint may be an item's."""
    places, fingerprints = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for low in range(0, len(words) - size + 1, SLAB):
        best = chosen(words[low : low + SLAB + size - 1, 0], size) * np.uint64(2 * size + 1)
        at = np.arange(len(best)) if cells is None else np.flatnonzero(has(cells, best))
        places.append(at + low)
        fingerprints.append(best[at])
    at, best = np.concatenate(places), np.concatenate(fingerprints)
    text = np.searchsorted(ends, at, "right")
    within = at + size <= ends[text]
    at, text, best = at[within], text[within], best[within]
    begins = np.concatenate(([0], ends[:-1]))
    return text, at - begins[text], best, rolled(words[:, 0], size, 0, at), rolled(words[:, 1], size, 1, at)


def cell(prints_: np.ndarray, bits: int) -> np.ndarray:
    return (prints_ >> np.uint64(64 - bits)).astype(np.int64)


def has(cells: np.ndarray, prints_: np.ndarray) -> np.ndarray:
    at = cell(prints_, len(cells).bit_length() + 2)
    return (cells[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def groups(parts: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list[list], list[bytes]]]:
    """Rows with texts of GROUP_BYTES together, or a longer text alone; null texts are empty."""
    for part in parts:
        others, texts = [part.column(c).to_pylist() for c in columns], part.column("text").cast(pa.binary())
        sizes = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int32, part.num_rows + 1, 4 * texts.offset))) if part.num_rows else []
        low = 0
        while low < part.num_rows:
            done = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, done + GROUP_BYTES, "right")))
            yield [c[low:high] for c in others], [x or b"" for x in texts.slice(low, high - low).to_pylist()]
            low = high


class Reader:
    """Texts as the hashes of their words, one after the other, and where each text ends."""

    def __init__(self) -> None:
        self.known = Lexicon()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > WORD_CACHE:
            self.known.forget()
        numbers, counts = [np.zeros(0, np.int32)], []
        for text in texts:
            n = 0
            for words in split_words(text.translate(_PLAIN)):
                numbers.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
                n += len(words)
            counts.append(n)
        return self.known.lanes()[np.concatenate(numbers)] if self.known else np.zeros((0, 2), np.uint64), np.cumsum(counts)


_ITEM = pa.schema([("print", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("size", pa.int32()), ("item_id", pa.int64())])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``print``, ``key_a``, ``key_b``, ``size`` and ``item_id`` of every window of the items."""

    def run(parts):
        reader = Reader()
        for (ids,), texts in groups(parts, "item_id"):
            words, ends = reader(texts)
            counts = np.diff(ends, prepend=0)
            for size in range(1, window + 1):
                fits = counts >= window if size == window else counts == size
                if not fits.any():
                    continue
                text, _, best, a, b = prints(words, ends, size, None)
                use = fits[text]
                rows = [best[use].view(np.int64), a[use].view(np.int64), b[use].view(np.int64), np.full(int(use.sum()), size, np.int32)]
                yield pa.record_batch([*(pa.array(x) for x in rows), pa.array([ids[t] for t in text[use].tolist()], pa.int64())], schema=_ITEM)

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "print long, key_a long, key_b long, size int, item_id long").distinct()


def print_table(windows: DataFrame) -> np.ndarray:
    """One bit per cell of the windows' fingerprints. A task sends its bits by ranges, so the driver receives the
    table's size at most, whatever the number of items."""
    n = windows.count()
    bits = min(CELL_BITS[1], max(CELL_BITS[0], n.bit_length() + SPARE_BITS))

    def run(parts):
        table = np.zeros(1 << bits - 3, np.uint8)
        for part in parts:
            at = cell(part.column(0).to_numpy().view(np.uint64), bits)
            np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield from table_parts(table)

    return gather_parts(windows.select("print").mapInArrow(run, "part int, data binary"), 1 << bits - 3, "or")


_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("print", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64())])


def document_windows(docs: DataFrame, cells: np.ndarray, sizes: list[int]) -> DataFrame:
    """One row per row of ``docs`` (``row``, ``doc_id``, ``n_words``), with null window columns, and one per window
    that may be an item's: ``start``, ``size``, ``print``, ``key_a``, ``key_b``."""
    packed = pa.compress(cells.tobytes(), codec="zstd", asbytes=True)
    n_bytes = len(cells)

    def run(parts):
        table = np.frombuffer(pa.decompress(packed, n_bytes, codec="zstd", asbytes=True), np.uint8)
        reader = Reader()
        for (rows, ids), texts in groups(parts, "row", "doc_id"):
            words, ends = reader(texts)
            none = pa.nulls(len(rows), pa.int64())
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(np.diff(ends, prepend=0)), none, pa.nulls(len(rows), pa.int32()), none, none, none], schema=_FOUND)
            at = np.array(rows, np.int64)
            for size in sizes:
                text, start, best, a, b = prints(words, ends, size, table)
                if len(text):
                    none = pa.nulls(len(text), pa.int64())
                    yield pa.record_batch([pa.array(at[text]), none, none, pa.array(start), pa.array(np.full(len(text), size, np.int32)), *(pa.array(x.view(np.int64)) for x in (best, a, b))], schema=_FOUND)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n_words long, start long, size int, print long, key_a long, key_b long")


def hit_words(hits: DataFrame) -> DataFrame:
    """``row`` and ``n_hit``, the words inside any window. Windows are cut at multiples of SEGMENT words, so a long
    document is counted in pieces."""
    first, last = F.floor(F.col("start") / SEGMENT), F.floor((F.col("start") + F.col("size") - 1) / SEGMENT)
    cut = hits.select("row", "start", (F.col("start") + F.col("size")).alias("end"), F.explode(F.sequence(first, last)).alias("segment"))
    low, high = F.greatest("start", F.col("segment") * SEGMENT), F.least("end", (F.col("segment") + 1) * SEGMENT)
    cut = cut.select("row", "segment", low.alias("low"), high.alias("high")).groupBy("row", "segment", "low").agg(F.max("high").alias("high"))
    along = Window.partitionBy("row", "segment").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    gained = F.greatest(F.lit(0), F.col("high") - F.greatest("low", F.coalesce(F.max("high").over(along), F.lit(0))))
    return cut.withColumn("gained", gained).groupBy("row").agg(F.sum("gained").alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (ids as text, sorted) and ``contaminated`` per row of
    ``docs``. A null text has no words and is never contaminated; an item without words occurs nowhere. Every row is
    judged by its own text, repeated rows and rows without a doc_id as well. Words hit by an item without an id count
    as hit, but such an item cannot be listed. Only ``doc_id``, ``item_id`` and the texts are read."""
    windows = materialise(item_windows(items, window))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    found = materialise(document_windows(docs, print_table(windows), sizes))
    # Items that have just the same windows in common are one set, so a passage of many items stays one row.
    keys = ["print", "key_a", "key_b", "size"]
    listed = windows.groupBy(*keys).agg(F.sort_array(F.collect_list("item_id")).alias("ids")).withColumn("set_id", F.md5(F.to_json("ids")))
    members = listed.groupBy("set_id").agg(F.first("ids").alias("ids")).select(F.col("set_id").alias("of"), F.explode("ids").alias("item_id"))
    side = lookup_side(listed.select(*keys, "set_id"), BROADCAST_WINDOWS)
    hits = materialise(found.filter("start IS NOT NULL").join(side, keys).select("row", "start", "size", "set_id"))
    sets = hits.select("row", "set_id").distinct()
    pairs = sets.join(lookup_side(members, BROADCAST_WINDOWS), F.col("set_id") == F.col("of")).select("row", F.col("item_id").cast("string").alias("item")).distinct()
    named = pairs.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items")).withColumnRenamed("row", "named_row")
    counted = hit_words(hits).withColumnRenamed("row", "hit_row")
    rows = found.filter("start IS NULL").select("row", "doc_id", "n_words")
    out = rows.join(counted, F.col("row") == F.col("hit_row"), "left").join(named, F.col("row") == F.col("named_row"), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (n_hit > 0).alias("contaminated"))
