"""Product codes of vectors by exact k-means with norm-of-sum bounds.

A vector of integers is cut into PARTS; each part has a codebook of ENTRIES. Of every part a block keeps its entry, an
upper bound of the distance to it and, for each of GROUPS groups of entries, a lower bound of the distance to the
others, every bound with the stamp of the round that measured it. The driver keeps the codebooks of all rounds (a few
thousand numbers each), so a bound of round s is corrected in round r by the true distance between an entry's places in
s and in r, the norm of the sum of its moves, and not by the sum of their norms. Only where a lower bound does not
exceed the upper one is a distance measured again, and only in the groups that failed. Distances are exact integers;
bounds are rounded outwards, so assignments and ties come out as with a full search.

A round is one pass over blocks, which are what a task reads at once; it writes the next table of blocks with each
block's sums. Only sums merged by ranges of entries come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import fresh_path, remove_path
from ravelin.operators.enrich import lookup_side

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
GROUPS = 8
SLICES = 16  # ranges of a codebook's entries whose sums are merged together
BLOCK_VALUES = 1 << 20  # components of a block
EXACT = 1 << 53  # whole numbers up to here are exact as doubles

Book = list  # of parts: int64 arrays (entries, width), or arrays of Python numbers where 64 bits are too few


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: int64, or Python numbers if any is very large."""
    wide = np.abs(vectors) >= 1 << 40
    if not wide.any():
        return np.floor(vectors.astype(np.float64) * SCALE).astype(np.int64)
    flat = [int(x) * SCALE if abs(x) >= 1 << 52 else math.floor(x * SCALE) for x in vectors.astype(np.float64).ravel().tolist()]
    return np.array([*flat, None], object)[:-1].reshape(vectors.shape)


def as_doubles(*arrays: np.ndarray) -> bool:
    """Whether squared distances between these fit a double exactly."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return 4 * most * most * max(1, arrays[0].shape[-1]) < EXACT


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x, rows of c) as doubles; see ``as_doubles``."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def plainly(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list]:
    """Nearest entries and squared distances in Python numbers, for components of any size."""
    best = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, entry)), e) for e, entry in enumerate(c)) for row in x]
    return np.array([e for _, e in best], np.int64), [d for d, _ in best]


def entry_groups(n: int) -> list[np.ndarray]:
    return np.array_split(np.arange(n), GROUPS)


@dataclass
class Bounds:
    """Of each row of a block's part: the entry, the upper bound and its stamp, lower bounds per group and theirs."""

    entry: np.ndarray
    upper: np.ndarray
    upper_at: np.ndarray
    lower: np.ndarray
    lower_at: np.ndarray

    KINDS = [(np.uint16, 1), (np.float32, 1), (np.uint8, 1), (np.float32, GROUPS), (np.uint8, GROUPS)]

    def packed(self) -> bytes:
        fields = (self.entry, self.upper, self.upper_at, self.lower, self.lower_at)
        return b"".join(np.ascontiguousarray(f, k).tobytes() for f, (k, _) in zip(fields, self.KINDS))

    @classmethod
    def unpacked(cls, data: bytes, n: int) -> Bounds:
        out, at = [], 0
        for kind, width in cls.KINDS:
            size = n * width * np.dtype(kind).itemsize
            field = np.frombuffer(data, kind, n * width, at)
            out.append(field.copy() if width == 1 else field.reshape(n, width).copy())
            at += size
        return cls(*out)


def _down(x):
    return np.asarray(x * (1 - 1e-6), np.float32)


def _up(x):
    return np.asarray(x * (1 + 1e-6), np.float32)


def measured(x: np.ndarray, c: np.ndarray, stamp: int) -> tuple[Bounds, np.ndarray]:
    """Bounds and squared distances from a full search."""
    rows, d = np.arange(len(x)), squared(x, c)
    entry = d.argmin(1)
    best = d[rows, entry].copy()
    d[rows, entry] = np.inf
    lower = np.stack([d[:, g].min(1) if len(g) else np.full(len(x), np.inf) for g in entry_groups(len(c))], 1)
    stamps = np.full(len(x), stamp)
    return Bounds(entry, _up(np.sqrt(best)), stamps, _down(np.sqrt(lower)), np.full((len(x), GROUPS), stamp)), best


def assign(x: np.ndarray, history: list[np.ndarray], held: Bounds) -> int:
    """Brings ``held`` up to date with the newest codebook of ``history``; the number of distances measured."""
    now = len(history) - 1
    c, groups = history[now], entry_groups(len(history[now]))
    moved = np.stack([np.sqrt(((c - old) ** 2).sum(1)) * (1 + 1e-9) for old in history])  # true net moves, by stamp
    group_moved = np.stack([moved[:, g].max(1) if len(g) else np.zeros(len(moved)) for g in groups], 1)
    upper = held.upper + moved[held.upper_at, held.entry]
    lower = held.lower - group_moved[held.lower_at, np.arange(GROUPS)]
    rows = np.flatnonzero((lower <= upper[:, None]).any(1))
    if not len(rows):
        return 0
    exact = ((x[rows] - c[held.entry[rows]]) ** 2).sum(1)
    held.upper[rows], held.upper_at[rows] = _up(np.sqrt(exact)), now
    fails = lower[rows] <= held.upper[rows].astype(np.float64)[:, None]
    searched, scanned = np.flatnonzero(fails.any(1)), len(rows)
    rows, fails = rows[searched], fails[searched]
    old, old_d = held.entry[rows].astype(np.int64), exact[searched]
    best, best_d = old.copy(), old_d.copy()
    least: dict[int, tuple] = {}
    for g, members in enumerate(groups):
        at = np.flatnonzero(fails[:, g])
        if not len(at) or not len(members):
            continue
        d = squared(x[rows[at]], c[members])
        scanned += d.size
        here = np.arange(len(at))
        one = d.argmin(1)
        d_one = d[here, one].copy()
        d[here, one] = np.inf
        least[g] = at, members[one], d_one, d.min(1)
        nearer = (d_one < best_d[at]) | ((d_one == best_d[at]) & (members[one] < best[at]))
        best[at[nearer]], best_d[at[nearer]] = members[one][nearer], d_one[nearer]
    for g, (at, one, d_one, d_two) in least.items():
        held.lower[rows[at], g] = _down(np.sqrt(np.where(best[at] == one, d_two, d_one)))
        held.lower_at[rows[at], g] = now
    changed = np.flatnonzero(best != old)
    of_old = np.searchsorted([g[-1] if len(g) else len(c) for g in groups], old[changed])
    kept = ~fails[changed, of_old]  # the old entry joins a group that was not searched
    r, g = rows[changed[kept]], of_old[kept]
    held.lower[r, g], held.lower_at[r, g] = _down(np.minimum(np.maximum(lower[r, g], 0), np.sqrt(old_d[changed[kept]]))), now
    held.entry[rows], held.upper[rows] = best, _up(np.sqrt(best_d))
    return scanned


def pack_integers(a: np.ndarray) -> bytes:
    return b"i" + a.astype("<i8").tobytes() if a.dtype != object else b"t" + ",".join(map(str, a.ravel().tolist())).encode()


def unpack_integers(data: bytes) -> np.ndarray:
    if data[:1] == b"i":
        return np.frombuffer(data[1:], "<i8")
    return np.array([*(int(x) for x in data[1:].decode().split(",") if x), None], object)[:-1]


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b if a.dtype == b.dtype else a.astype(object) + b.astype(object)


def sums_of(x: np.ndarray, entry: np.ndarray, n: int) -> np.ndarray:
    """Per entry the count and the sums of its rows."""
    out = np.zeros((n, x.shape[1] + 1), x.dtype if x.dtype == object else np.int64)
    order = np.argsort(entry, kind="stable")
    used, first, counts = np.unique(entry[order], return_index=True, return_counts=True)
    if len(used):
        out[used, 0], out[used, 1:] = counts, np.add.reduceat(x[order], first, axis=0)
    return out


def borders(width: int) -> list[int]:
    return [i * width // PARTS for i in range(PARTS + 1)]


_BLOCK = pa.schema([("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("vectors", pa.binary()), ("bounds", pa.list_(pa.binary())), ("sums", pa.list_(pa.binary())), ("scanned", pa.int64())])
_BLOCK_SQL = "vec_ids array<long>, labels array<string>, vectors binary, bounds array<binary>, sums array<binary>, scanned long"


def searched(vectors: np.ndarray, held: list[bytes] | None, books: list[Book]) -> tuple[list[bytes], list[bytes], int]:
    """A block's bounds and sums under the newest codebook, by part, and the distances measured."""
    cuts, bounds, sums, scanned = borders(vectors.shape[1]), [], [], 0
    for part in range(PARTS):
        x, history = integers(vectors[:, cuts[part] : cuts[part + 1]]), [b[part] for b in books]
        if as_doubles(x, *history):
            doubles = [h.astype(np.float64) for h in history]
            if held is None or not held[part]:
                state = measured(x.astype(np.float64), doubles[-1], len(books) - 1)[0]
                scanned += len(x) * len(history[-1])
            else:
                state = Bounds.unpacked(held[part], len(x))
                scanned += assign(x.astype(np.float64), doubles, state)
            entry = state.entry.astype(np.int64)
            bounds.append(state.packed())
        else:
            entry = plainly(x, history[-1])[0]
            bounds.append(b"")
        sums.append(pack_integers(sums_of(x, entry, len(history[-1]))))
    return bounds, sums, scanned


def block_rows(rows: DataFrame, width: int, kind: str, books: list[Book]) -> DataFrame:
    """The first round: vectors become blocks, as a task reads them."""
    most = max(1, BLOCK_VALUES // max(width, 1))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for low in range(0, batch.num_rows, most):
                some = batch.slice(low, most)
                values = some.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(some.num_rows, width)
                bounds, sums, scanned = searched(values, None, books)
                row = [[some.column("vec_id").to_pylist()], [some.column("label").to_pylist()], [values.tobytes()], [bounds], [sums], [scanned]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(row, _BLOCK)], schema=_BLOCK)

    return rows.mapInArrow(run, _BLOCK_SQL)


def next_round(blocks: DataFrame, width: int, kind: str, books: list[Book]) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i in range(batch.num_rows):
                values = np.frombuffer(batch.column("vectors")[i].as_py(), kind).reshape(len(batch.column("vec_ids")[i]), width)
                bounds, sums, scanned = searched(values, batch.column("bounds")[i].as_py(), books)
                own = [batch.column(c).slice(i, 1) for c in ("vec_ids", "labels", "vectors")]
                yield pa.record_batch([c.cast(f.type) for c, f in zip(own, _BLOCK)] + [pa.array(c, f.type) for c, f in zip([[bounds], [sums], [scanned]], list(_BLOCK)[3:])], schema=_BLOCK)

    return blocks.mapInArrow(run, _BLOCK_SQL)


def summed(blocks: DataFrame, width: int) -> list[np.ndarray]:
    """Counts and sums per part and entry over all blocks, merged by ranges of entries."""
    cuts = borders(width)
    wide = [b - a + 1 for a, b in zip(cuts, cuts[1:])]

    def sent(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for key, a in held.items():
            yield pa.record_batch([pa.array([key], pa.int32()), pa.array([pack_integers(a)], pa.binary())], names=["slice", "data"])

    def put(held: dict[int, np.ndarray], key: int, a: np.ndarray) -> None:
        held[key] = joined(held[key], a) if key in held else a

    def by_task(parts):
        held: dict[int, np.ndarray] = {}
        for batch in parts:
            for sums in batch.column("sums").to_pylist():
                for part, data in enumerate(sums):
                    a = unpack_integers(data).reshape(-1, wide[part])
                    for s, piece in enumerate(np.array_split(a, SLICES)):
                        put(held, part * SLICES + s, piece.ravel())
        yield from sent(held)

    def merged(parts):
        held: dict[int, np.ndarray] = {}
        for batch in parts:
            for key, data in zip(batch.column("slice").to_pylist(), batch.column("data").to_pylist()):
                put(held, key, unpack_integers(data))
        yield from sent(held)

    rows = blocks.select("sums").mapInArrow(by_task, "slice int, data binary").repartition("slice").mapInArrow(merged, "slice int, data binary").collect()
    pieces = {r["slice"]: unpack_integers(bytes(r["data"])) for r in rows}
    out = []
    for part in range(PARTS):
        mine = [pieces[part * SLICES + s] for s in range(SLICES)]
        mine = [m.astype(object) for m in mine] if any(m.dtype == object for m in mine) else mine
        out.append(np.concatenate(mine).reshape(-1, wide[part]))
    return out


def moved_book(book: Book, sums: list[np.ndarray]) -> Book:
    """Every used entry at the floor of its rows' mean."""
    out = []
    for old, s in zip(book, sums):
        used = s[:, 0] > 0
        dtype = object if object in (old.dtype, s.dtype) else np.int64
        new = old.astype(dtype)
        new[used] = s[used, 1:] // s[used, :1]
        out.append(new)
    return out


@dataclass
class Coded:
    """``blocks`` is the written table of the last pass, ``books`` the codebooks of all rounds, ``scanned`` the
    distances measured in each pass."""

    blocks: DataFrame
    books: list[Book]
    width: int
    kind: str
    scanned: list[int]


def trained(spark: SparkSession, rows: DataFrame, width: int, kind: str, entries: int, rounds: int) -> Coded:
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = integers(np.array([r["embedding"] for r in first], np.float64).reshape(len(first), width))
    cuts = borders(width)
    books: list[Book] = [[start[:, a:b] for a, b in zip(cuts, cuts[1:])]]
    before, blocks, scanned = None, None, []
    for _ in range(rounds + 1):
        plan = block_rows(rows, width, kind, books) if blocks is None else next_round(blocks, width, kind, books)
        path = fresh_path(spark, "codes")
        plan.write.parquet(path)
        blocks = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
        scanned.append(int(blocks.agg(F.sum("scanned")).first()[0] or 0))
        if len(books) <= rounds:
            books.append(moved_book(books[-1], summed(blocks, width)))
    return Coded(blocks, books, width, kind, scanned)


_CODE = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.decimal128(38, 0))])


def codes(coded: Coded) -> DataFrame:
    """``vec_id``, ``label``, ``code`` and ``error`` per vector."""
    width, kind, book = coded.width, coded.kind, coded.books[-1]
    cuts = borders(width)

    def run(parts):
        for batch in parts:
            for i in range(batch.num_rows):
                values = np.frombuffer(batch.column("vectors")[i].as_py(), kind).reshape(len(batch.column("vec_ids")[i]), width)
                held, entries, errors = batch.column("bounds")[i].as_py(), [], [0] * len(values)
                for part in range(PARTS):
                    x, c = integers(values[:, cuts[part] : cuts[part + 1]]), book[part]
                    if held[part]:
                        entry = Bounds.unpacked(held[part], len(x)).entry.astype(np.int64)
                        found = ((x - c[entry]) ** 2).sum(1).tolist()
                    else:
                        entry, found = plainly(x, c)
                    entries.append(entry.tolist())
                    errors = [a + b for a, b in zip(errors, found)]
                told = ["".join(f"{e:02x}" for e in row) for row in zip(*entries)]
                row = [batch.column("vec_ids")[i].as_py(), batch.column("labels")[i].as_py(), told, [min(e, 1 << 63) for e in errors]]  # what passes 64 bits does so in sums as well
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(row, _CODE)], schema=_CODE)

    return coded.blocks.mapInArrow(run, "vec_id long, label string, code string, error decimal(38,0)")


def book_digest(book: Book) -> str:
    told = ",".join(str(int(x)) for part in book for x in part.ravel().tolist())
    return hashlib.sha256(told.encode()).hexdigest()


def compress_vectors(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``code`` (two hex digits per part), ``error``, ``label_error`` and ``codebooks_sha256`` per vector.

    Vectors that are null or hold a null or non-finite component have no row. The first vector (by vec_id, null ids
    last, then by content) sets the length; a vector of another length gets a null code and error and takes no part.
    Repeated rows and ids are rows of their own. With fewer vectors than ``entries`` the codebooks have one entry per
    vector. Sums of errors that pass 64 bits are null. Only ``vec_id``, ``embedding`` and ``label`` are read."""
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    unfit = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")).filter(F.col("embedding").isNotNull() & ~unfit)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = first["n"]
    fits = F.size("embedding") == width
    coded = trained(spark, kept.filter(fits), width, kind, min(entries, ENTRIES), rounds)
    others = kept.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("decimal(38,0)").alias("error"))
    rows = codes(coded).union(others)
    totals = lookup_side(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("total")))
    out = rows.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", F.expr("try_cast(error AS bigint)").alias("error"), F.expr("try_cast(total AS bigint)").alias("label_error"), F.lit(book_digest(coded.books[-1])).alias("codebooks_sha256"))
