"""Log files that grow, as a stream: whole lines appended since the last trigger, each once.

The source's offset is what has been read of each file: its length up to the last line end, and a digest of its first
bytes. A file that is shorter than that, or begins otherwise, was cut or replaced by a new one under its name and is read
from its start; one that was moved to another name of the pattern goes on where it was. Files that are gone are
forgotten. A trigger's lines are cut into ranges of ``rangeBytes`` that tasks read on their own, so one large file
spreads over tasks. A trigger takes ``maxBytes`` at most; the engine does not tell a source where a query stands when it
starts, so its first trigger takes all there is, unless the option ``checkpoint`` names the query's checkpoint folder.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail").option("path", "/var/log/*.log").load()

Files are opened by path where the tasks run, so they must lie where every machine sees them (a mounted share).
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

HEAD_BYTES = 256
MAX_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
LOOK_BYTES = 1 << 16


@dataclass
class Lines(InputPartition):
    """The lines of a file that begin from ``low`` up to ``high``."""

    path: str
    low: int
    high: int


def head_of(path: str, size: int) -> str:
    with open(path, "rb") as file:
        return hashlib.blake2b(file.read(min(size, HEAD_BYTES)), digest_size=8).hexdigest()


def logged_offset(checkpoint: str) -> dict:
    """What the newest offset of a query's checkpoint says of its first source; nothing for a new query."""
    folder = os.path.join(checkpoint.removeprefix("file://"), "offsets")
    names = [n for n in os.listdir(folder) if n.isdigit()] if os.path.isdir(folder) else []
    if not names:
        return {}
    with open(os.path.join(folder, max(names, key=int))) as file:
        return json.loads(file.read().split("\n")[2])  # after the version and the batch's metadata


def seen_of(path: str, end: int) -> dict:
    sampled = min(end, HEAD_BYTES)
    return {"end": end, "sampled": sampled, "head": head_of(path, sampled)}


def is_same(path: str, seen: dict) -> bool:
    return os.path.exists(path) and head_of(path, seen["sampled"]) == seen["head"]


def read_before(path: str, size: int, start: dict) -> int:
    """How much of the first ``size`` bytes of a file was read, under this name or, if the file has since been moved
    here, under another; nothing of a file that was cut or replaced."""
    seen = start.get(path)
    if seen and seen["end"] <= size and is_same(path, seen):
        return seen["end"]
    for other, was in start.items():
        if other != path and 0 < was["end"] <= size and is_same(path, was) and not is_same(other, was):
            return was["end"]
    return 0


def last_line_end(path: str, low: int, high: int) -> int:
    """The place after the last line end between ``low`` and ``high``, or ``low``."""
    with open(path, "rb") as file:
        at = high
        while at > low:
            begin = max(low, at - LOOK_BYTES)
            file.seek(begin)
            found = file.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return low


def next_line_end(path: str, low: int, high: int) -> int:
    """The place after the first line end from ``low`` on, at ``high`` at most."""
    with open(path, "rb") as file:
        file.seek(low)
        at = low
        while at < high:
            data = file.read(min(LOOK_BYTES, high - at))
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            if not data:
                break
            at += len(data)
    return high


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, max_bytes: int, range_bytes: int, from_end: bool, checkpoint: str | None) -> None:
        self.pattern, self.max_bytes, self.range_bytes = path, max_bytes, range_bytes
        self.from_end = from_end
        self.known: dict[str, dict] | None = logged_offset(checkpoint) if checkpoint else None  # what was read before

    def _files(self) -> list[str]:
        pattern = os.path.join(self.pattern, "*") if os.path.isdir(self.pattern) else self.pattern
        return sorted(p for p in glob.glob(pattern) if os.path.isfile(p))

    def initialOffset(self) -> dict:
        """Nothing read yet; with ``startAt=end`` what is there already counts as read."""
        self.known = {p: seen_of(p, last_line_end(p, 0, os.path.getsize(p))) for p in self._files()} if self.from_end else {}
        return self.known

    def latestOffset(self) -> dict:
        """The ends of all files, or as far as ``max_bytes`` go."""
        start, out = self.known or {}, {}
        left = self.max_bytes if self.known is not None else 1 << 62
        for path in self._files():
            try:
                size = os.path.getsize(path)
                low = read_before(path, size, start)
                high = last_line_end(path, low, min(size, low + left)) if left > 0 else low
                if high == low and 0 < left < size - low:
                    high = next_line_end(path, low, last_line_end(path, low, size))  # one longer than a trigger goes alone
                out[path] = seen_of(path, high)
                left -= high - low
            except FileNotFoundError:
                continue  # it went since it was listed
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        self.known, out = end, []
        for path, seen in end.items():
            high = seen["end"]
            try:
                low = read_before(path, high, start)
            except FileNotFoundError:
                continue
            out += [Lines(path, a, min(a + self.range_bytes, high)) for a in range(low, high, self.range_bytes)]
        return out

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Lines) -> Iterator[tuple]:
        """Lines that begin in the range; the first of them begins after a line end, if the range is not the first."""
        with open(partition.path, "rb") as file:
            at = partition.low
            if at:
                file.seek(at - 1)
                if file.read(1) != b"\n":
                    at += len(file.readline())
            file.seek(at)
            while at < partition.high:
                line = file.readline()
                if not line:
                    break
                begins, at = at, at + len(line)
                text = line.rstrip(b"\n").rstrip(b"\r").decode("utf-8", "replace")
                if text:
                    yield partition.path, begins, text


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, offset bigint, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        if "path" not in self.options:
            raise ValueError("tail needs the option path")
        number = lambda name, default: int(self.options.get(name, default))
        return TailReader(self.options["path"], number("maxBytes", MAX_BYTES), number("rangeBytes", RANGE_BYTES), self.options.get("startAt", "start") == "end", self.options.get("checkpoint"))


def tail_growing_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """``(path, offset, line)`` of non-empty lines of the files at ``path`` (a folder or a pattern), as they grow."""
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("tail").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
