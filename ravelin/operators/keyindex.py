"""An index of the keys a table holds, so that insert-if-absent does not read the table.

Keys are hashed; the high bits of the hash name a bucket. A bucket has small runs: a run of key hashes in order, and its
Bloom filter. The highest bits name a folder: up to ``2 ** FOLDER_BITS`` buckets have one each, of more buckets those that
make ``BUCKET_KEYS`` keys share one, so small buckets cost rows and not files. The runs of a batch are looked up bucket by bucket: a task reads the filters of the buckets
its batch meets and the runs of those whose filter does not rule all keys out. When buckets have grown past
``BUCKET_KEYS`` on average, the index is written anew with more of them, and its many runs become one per bucket; so what
a batch reads depends on the batch and not on the table.

An insert writes a mark, then the rows, then their keys, then takes the mark away. A mark that is found tells that an
insert broke off; the index is then built again from the table, and the repeated batch adds what is missing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.names import free
from ravelin.operators import persist
from ravelin.session import materialise

BUCKET_KEYS = 1 << 17  # keys of a bucket on average before the index is written with more buckets
FOLDER_BITS = 8
MOST_RUNS = 16  # batches after which the runs are merged
FILTER_BITS = 10  # per key
HASHES = 5
READ_AT_ONCE = 1 << 16  # bucket numbers a batch may list on the driver; a batch that meets more reads all buckets


class Files:
    """The few calls on the table's file system that a Spark reader does not offer."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.spark, self.root = spark, root.rstrip("/")

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(f"{self.root}/{name}"))

    def remove(self, name: str) -> None:
        self.system.delete(self.path(f"{self.root}/{name}"), True)

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside and moved."""
        aside = f"{self.root}/{name}.{uuid.uuid4().hex}"
        out = self.system.create(self.path(aside), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.remove(name)
        self.system.rename(self.path(aside), self.path(f"{self.root}/{name}"))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.system.open(self.path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


@dataclass(frozen=True)
class State:
    """Which generation of the index holds, in how many buckets (as bits), and what it has."""

    generation: str
    bits: int
    keys: int
    runs: tuple[str, ...]
    folder_bits: int | None = None  # null: written before buckets shared folders

    def folder(self, bucket: Column) -> Column:
        return F.shiftright(bucket, self.bits - self.folder_bits)


_RUN_SQL = "folder int, bucket int, part string, low long, data binary"


def buckets_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)


def filter_of(hashes: np.ndarray) -> bytes:
    """A Bloom filter of the hashes; its size follows their number."""
    size = max(64, 1 << max(0, int(len(hashes) * FILTER_BITS - 1).bit_length()))
    bits = np.zeros(size, bool)
    for places in places_of(hashes, size):
        bits[places] = True
    return np.packbits(bits).tobytes()


def places_of(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    one, two = hashes, hashes * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    for i in range(HASHES):
        yield ((one + np.uint64(i) * two) >> np.uint64(7)) & np.uint64(size - 1)


def may_hold(packed: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
    out = np.ones(len(hashes), bool)
    for places in places_of(hashes, len(bits)):
        out &= bits[places]
    return out


def run_rows(keyed: DataFrame, state: State) -> DataFrame:
    """``keyed`` has ``bucket`` and ``hash``: per bucket a row with its hashes in order and one with their filter. A folder
    is one group; in the order of hashes its buckets follow each other."""
    bits = state.bits

    def run(key, table):
        hashes = np.unique(table["hash"].to_numpy().view(np.uint64))
        buckets, begins = np.unique(buckets_of(hashes, bits), return_index=True)
        rows = []
        for bucket, held in zip(buckets.tolist(), np.split(hashes, begins[1:])):
            rows += [(bucket, "filter", len(held), filter_of(held)), (bucket, "keys", len(held), held.tobytes())]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
        columns = [[key[0].as_py()] * len(rows), *zip(*rows)]
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], names=["folder", "bucket", "part", "low", "data"])

    return keyed.select(state.folder(F.col("bucket")).alias("folder"), "hash").groupBy("folder").applyInArrow(run, _RUN_SQL)


class KeyIndex:
    """The index of the table at ``table`` by the column ``key``; one writer at a time."""

    def __init__(self, spark: SparkSession, table: str, key: str = "event_id", root: str | None = None, bucket_keys: int = BUCKET_KEYS, most_runs: int = MOST_RUNS) -> None:
        self.spark, self.table, self.key, self.bucket_keys, self.most_runs = spark, table.rstrip("/"), key, bucket_keys, most_runs
        self.root = (root or f"{self.table}_keys").rstrip("/")
        self.files = Files(spark, self.root)

    def state(self) -> State | None:
        text = self.files.read("state.json")
        return State(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()}) if text else None

    def _current(self) -> State:
        """The state, after the index was built if there is none or one of another layout."""
        state = self.state()
        return state if state and state.folder_bits is not None else self.build()

    def _fresh(self, keys: int, least_bits: int = 0) -> State:
        """A new generation without runs, with as many buckets as the keys ask for."""
        return self._laid_out(min(24, max(least_bits, (keys // self.bucket_keys).bit_length())), keys)

    def _laid_out(self, bits: int, keys: int) -> State:
        shared = max(0, (BUCKET_KEYS // self.bucket_keys).bit_length() - 1)
        return State(f"g{uuid.uuid4().hex}", bits, keys, (), max(min(bits, FOLDER_BITS), bits - shared))

    def _put(self, state: State) -> None:
        self.files.write("state.json", json.dumps(vars(state)))

    def keyed(self, rows: DataFrame, bits: int) -> DataFrame:
        """``rows`` with ``hash`` and ``bucket``; a null key is a key like others."""
        value = F.xxhash64(F.coalesce(F.col(self.key).cast("string"), F.lit("\u0000null")))
        return rows.withColumn("hash", value).withColumn("bucket", self._bucket(value, bits))

    @staticmethod
    def _bucket(value: Column, bits: int) -> Column:
        return F.shiftrightunsigned(value, 64 - bits).cast("int") if bits else F.lit(0)

    def _path(self, state: State, run: str, part: str) -> str:
        return f"{self.root}/{state.generation}/{run}/part={part}"

    def _write_run(self, keyed: DataFrame, state: State, run: str) -> None:
        """The run, and then the list of the folders it has, so that looking one up lists no folders."""
        name = f"{state.generation}/{run}"
        run_rows(keyed, state).write.mode("overwrite").partitionBy("part", "folder").parquet(f"{self.root}/{name}")
        held = self.spark.read.parquet(f"{self.root}/{name}/part=filter").select("folder").distinct()
        self.files.write(f"{name}/_folders.json", json.dumps(sorted(r["folder"] for r in held.collect())))

    def build(self, bits: int | None = None) -> State:
        """The index anew from the table, with one run per bucket."""
        stored = persist.read_table(self.spark, self.table)
        n = 0 if stored is None else stored.count()
        old, fresh = self.state(), self._fresh(n) if bits is None else self._laid_out(bits, n)
        if n:
            self._write_run(self.keyed(stored.select(self.key), fresh.bits), fresh, "run=base")
            fresh = replace(fresh, runs=("run=base",))
        self._put(fresh)
        if old:
            self.files.remove(old.generation)
        return fresh

    def _merged(self, state: State) -> State:
        """All runs as one per bucket, in as many buckets as the keys ask for; the table is not read."""
        fresh = replace(self._fresh(state.keys, state.bits), runs=("run=base",))

        def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for data in part.column("data").to_pylist():
                    yield pa.record_batch([pa.array(np.frombuffer(data, np.int64))], names=["hash"])

        paths = [self._path(state, run, "keys") for run in state.runs]
        rows = self._read(state, paths).select("data").mapInArrow(hashes, "hash long")
        self._write_run(rows.withColumn("bucket", self._bucket(F.col("hash"), fresh.bits)), fresh, "run=base")
        self._put(fresh)
        self.files.remove(state.generation)
        return fresh

    def _runs(self, state: State, part: str, buckets: list[int] | None) -> DataFrame | None:
        """The rows of the named buckets' folders in all runs; only they are listed and read."""
        paths = []
        folders = None if buckets is None else sorted({b >> (state.bits - state.folder_bits) for b in buckets})
        for run in state.runs:
            base = self._path(state, run, part)
            if folders is None:
                paths.append(base)
            else:
                held = set(json.loads(self.files.read(f"{state.generation}/{run}/_folders.json") or "[]"))
                paths += [f"{base}/folder={f}" for f in folders if f in held]
        if not paths:
            return None
        return self._read(state, paths).select("bucket", "data")

    def _read(self, state: State, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("bucket int, low long, data binary").option("basePath", f"{self.root}/{state.generation}").parquet(*paths)

    def _hits(self, state: State, keyed: DataFrame, runs: DataFrame, exact: bool) -> DataFrame:
        """The hashes (with their buckets) that a filter lets through, or that a run holds."""
        bits = state.bits

        def look(left, right):
            mine = np.unique(left["hash"].to_numpy().view(np.uint64))
            mine_in = buckets_of(mine, bits).astype(np.int64)
            found = np.zeros(len(mine), bool)
            ends = (np.searchsorted(mine_in, right["bucket"].to_numpy(), side) for side in ("left", "right"))
            for low, high, data in zip(*ends, right["data"]):
                if low < high:
                    raw, some = data.as_py(), mine[low:high]
                    found[low:high] |= np.isin(some, np.frombuffer(raw, np.uint64)) if exact else may_hold(raw, some)
            return pa.table([pa.array(mine_in[found].astype(np.int32)), pa.array(mine[found].view(np.int64))], names=["bucket", "hash"])

        folder = state.folder(F.col("bucket")).alias("folder")
        held = runs.select(folder, "bucket", "data").groupBy("folder")
        return keyed.select(folder, "hash").groupBy("folder").cogroup(held).applyInArrow(look, "bucket int, hash long")

    def _buckets(self, keyed: DataFrame) -> list[int] | None:
        rows = keyed.select("bucket").distinct().limit(READ_AT_ONCE + 1).collect()
        return None if len(rows) > READ_AT_ONCE else sorted(r["bucket"] for r in rows)

    def absent(self, rows: DataFrame) -> DataFrame:
        """The rows of a batch (one per key) whose key the table does not hold: ``rows`` with ``hash`` and ``bucket``."""
        state = self._current()
        keyed = materialise(self.keyed(rows, state.bits))
        filters = self._runs(state, "filter", self._buckets(keyed))
        if filters is None:
            return keyed
        likely = materialise(self._hits(state, keyed, filters, False))
        runs = self._runs(state, "keys", self._buckets(likely))
        if runs is None:
            return keyed
        held = self._hits(state, likely, runs, True).select(F.col("hash").alias("held"))
        return keyed.join(held, F.col("hash") == F.col("held"), "left_anti")

    def insert(self, rows: DataFrame, created_at=None) -> None:
        """Appends the rows whose key is not in the table, as ``persist.insert_if_absent`` does."""
        (clash_hash, clash_bucket) = free(rows, "hash", "bucket")
        if (clash_hash, clash_bucket) != ("hash", "bucket"):
            raise ValueError("stored rows cannot have columns named hash and bucket")
        if self.files.exists("writing"):
            self.build()
        else:
            self._current()
        fresh = materialise(self.absent(persist.first_by(rows, self.key, "timestamp")))
        n = fresh.count()
        if n:
            state, run = self.state(), f"run={uuid.uuid4().hex}"
            if not state.runs:  # the first rows say how many buckets there are
                state = replace(self._fresh(n), keys=0, generation=state.generation)
                fresh = fresh.withColumn("bucket", self._bucket(F.col("hash"), state.bits))
            self.files.write("writing", run)
            persist.append_rows(fresh.drop("hash", "bucket"), self.table, created_at)
            self._write_run(fresh, state, run)
            self._put(replace(state, keys=state.keys + n, runs=(*state.runs, run)))
            self.files.remove("writing")
        state = self.state()
        if len(state.runs) > self.most_runs or state.keys > 2 * self.bucket_keys << state.bits:
            self._merged(state)
