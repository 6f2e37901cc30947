"""Helpers the operators of this package share."""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.session import ensure_checkpoint_dir, materialise

__all__ = ["WORD", "WORD_CACHE", "batches", "block_count", "drop_exchanges", "fresh_path", "gather_parts", "materialise", "packed_part", "remove_path", "settled", "sha256", "split_words", "table", "table_parts", "text_rows", "unpacked_part", "word_ids", "words_of"]

WORD = r"[^\x20\x09-\x0D]+"
WORD_CACHE = 200_000  # distinct words a task remembers before it starts its dictionary anew


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | bytes | None) -> list[bytes]:
    """Maximal runs without ASCII white space, as UTF-8; ``bytes.split`` cuts at just these six bytes."""
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split()


def word_ids(words: list, known: dict) -> np.ndarray:
    """Numbers equal for equal words; ``known`` grows by the new ones."""
    if len(known) > WORD_CACHE:
        known.clear()
    put = known.setdefault
    return np.fromiter((put(w, len(known)) for w in words), np.int64, len(words))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and the named columns only, so that no other column can clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def block_count(docs: DataFrame, per_block: int, column: str = "text") -> int:
    """Blocks of about ``per_block`` bytes for all texts: one pass that returns a single number."""
    total = docs.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // per_block))


def batches(each: Callable[[list], list[tuple]], schema: pa.Schema, *columns: str) -> Callable:
    """A function for ``mapInArrow``: ``each`` gets one row's columns and returns output rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = [part.column(name) for name in columns]
            out = [row for i in range(part.num_rows) for row in each([c[i].as_py() for c in lists])]
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


SPLIT_BYTES = 1 << 20  # text split into words at once
PART_BYTES = 1 << 18  # bytes of a table that travel in one row


def split_words(text: bytes, keep: bool = False, size: int = SPLIT_BYTES) -> Iterator[list[bytes]]:
    """The words of a text without other white space than spaces, some at a time, so that a very long text never lies
    in memory as a list of words. With ``keep`` only spaces separate, and two of them have an empty word between."""
    low = 0
    while low < len(text):
        high = text.find(b" ", low + size)
        high = len(text) if high < 0 else high
        yield text[low:high].split(b" ") if keep else text[low:high].split()
        low = high + 1


def table_parts(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's table of bytes as rows ``part``, ``data``; parts without content are left out."""
    for part, low in enumerate(range(0, len(table), PART_BYTES)):
        piece = table[low : low + PART_BYTES]
        if piece.any():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([packed_part(piece)], pa.binary())], names=["part", "data"])


def packed_part(piece: np.ndarray) -> bytes:
    """Compressed: a part with few bytes set as the steps between them, as byte planes, and the bytes."""
    at = np.flatnonzero(piece)
    if 4 * len(at) > len(piece):
        return b"\0" + pa.compress(piece.tobytes(), codec="zstd", asbytes=True)
    steps = np.diff(at, prepend=0).astype("<u4")
    planes = steps.view(np.uint8).reshape(-1, 4).T[:3].tobytes() + piece[at].tobytes()
    return b"\1" + len(at).to_bytes(4, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpacked_part(data: bytes, size: int) -> np.ndarray:
    if data[:1] == b"\0":
        return np.frombuffer(pa.decompress(data[1:], size, codec="zstd", asbytes=True), np.uint8)
    out, n = np.zeros(size, np.uint8), int.from_bytes(data[1:5], "little")
    if n:
        planes = np.frombuffer(pa.decompress(data[5:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
        out[np.cumsum(planes[0] + (planes[1].astype(np.int64) << 8) + (planes[2].astype(np.int64) << 16))] = planes[3]
    return out


def gather_parts(rows: DataFrame, size: int, how: str) -> np.ndarray:
    """The tables of all tasks as one: their bits joined (``or``), or their sums up to 255 (``sum``). Parts are merged
    where they meet, one array per part; the driver receives ``size`` bytes at most."""

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in parts:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                new = unpacked_part(data.as_py(), min(PART_BYTES, size - part * PART_BYTES))
                old = held.get(part)
                if old is None:
                    held[part] = new
                elif how == "or":
                    held[part] = old | new
                else:
                    held[part] = old + np.minimum(new, ~old)
        for part, table in held.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([packed_part(table)], pa.binary())], names=["part", "data"])

    out = np.zeros(size, np.uint8)
    for row in rows.repartition("part").mapInArrow(merge, "part int, data binary").collect():
        low = row["part"] * PART_BYTES
        n = min(PART_BYTES, size - low)
        out[low : low + n] = unpacked_part(bytes(row["data"]), n)
    return out


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, after which the exchanges it was made of may go. Spark drops their files when nothing
    refers to them and garbage is collected, which a driver with a large heap may not do for long; so it is asked to."""
    out = materialise(df)
    del df
    drop_exchanges(out.sparkSession)
    return out


def drop_exchanges(spark: SparkSession) -> None:
    """Lets the files of exchanges go that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a table that a later one has replaced."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
