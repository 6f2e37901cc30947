"""Phrase collocations by dynamic itemset counting.

The corpus is written once as numbers of words, in SHARDS shards, which are scanned in a cycle. Words are counted from the first scan on; a
longer phrase becomes active as soon as both its subphrases (without the last and without the first word) have reached
the threshold, in whatever shard that is, and is counted until every shard has been seen once. So each scan counts
phrases of all lengths that are due in it.

How far subphrases have come is kept in a table of cells, one byte per cell for the count (capped) and one for the scan
in which it reached the threshold. Cells are shared, so a count there is never too low: a phrase may start a scan too
early or without need, but none is missed, and its cycle is whole in any case, as it follows from the stamps. The table
is bounded in size; tasks send theirs merged, by parts. The counts themselves are exact: a scan writes them per block, in
compressed runs of word numbers. At the end phrases whose cell stayed below the threshold are left out (the longest ones
have cells of their own for this), and the rest is summed up per task and dealt to ranges of phrases, still as runs of
word numbers. Only where all runs of a range meet do phrases become rows of text, those that reach the threshold, so no
row is exchanged per block and phrase. Where so much text fills the cells that few phrases are left out, this is done for
one slice of the ranges after the other, so that an exchange never holds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import drop_exchanges, fresh_path, gather_parts, remove_path, settled, split_words, table_parts
from ravelin.llm.windowdedup import pack, unpack
from ravelin.operators.enrich import lookup_side

LEAST = 10  # occurrences of a candidate
LONGEST = 3  # words
WITHIN_PERCENT = 50  # share of its occurrences within a longer candidate from which a phrase goes
KEPT = 2_000  # phrases reported per language
SHARDS = 3
CHUNK_BYTES = 16 << 20  # text of a block at most
MERGE_ROWS = 1_000_000  # counts a task holds before it sums them up
DEAL_ROWS = 4_000_000  # counts a task joins before it deals them out
RANGE_BYTES = 32 << 20  # text for each range of phrases
CELL_BITS = (16, 25)  # least and greatest size of the table of cells, as powers of two
SLICES = 2  # more of the phrases, grouped one after the other, where all cells are full
SALTS = 16  # parts of a language ranked by themselves first

#: Ends of pieces become line feeds, tabs become spaces, A-Z becomes a-z.
_PLAIN = bytes(0x0A if chr(b) in ".,;:!?\n\v\f\r" else 0x20 if b == 9 else b for b in range(256)).lower()
_FACTORS = [np.uint64(x) for x in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)]
_BREAK, _NOTHING = 0, 1  # numbers of the end of a piece and of what stands between two spaces


class Words(dict):
    """Numbers of the words of one block."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        for mark in (b"\n", b""):
            self[mark]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.texts.append(word)
        return number


def extended(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all but its last word and that of its last word."""
    x = first * _FACTORS[0] + last * _FACTORS[1] + np.uint64(1)
    return x ^ (x >> np.uint64(29))


class Progress:
    """The table of cells: capped counts, and the scan from which a cell's phrases count as frequent (0: not yet). The
    second half is for the longest phrases."""

    def __init__(self, bits: int) -> None:
        self.bits, self.counts, self.since = bits, np.zeros(2 << bits, np.uint8), np.zeros(2 << bits, np.uint8)

    def add(self, counts: np.ndarray, scan: int, least: int) -> None:
        self.counts += np.minimum(counts, ~self.counts)
        self.since[(self.counts >= min(least, 255)) & (self.since == 0)] = scan + 1

    def shorter(self) -> np.ndarray:
        return self.since[: 1 << self.bits]

    def full(self) -> float:
        """The share of cells that reached the threshold, in the fuller half."""
        return float((self.since.reshape(2, -1) > 0).mean(1).max())


def packed(since: np.ndarray) -> bytes:
    return pa.compress(since.tobytes(), codec="zstd", asbytes=True)


def unzipped(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), np.uint8)


def zipped(data: bytes) -> bytes:
    """Compressed with its length, so that a batch of blocks stays small."""
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def unpacked(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


def packed_run(found: list[tuple[list[np.ndarray], np.ndarray]], texts: list[bytes]) -> bytes:
    """The words in use, and by length the phrases as one column of word numbers per place, with their counts. Phrases
    lie in order of their first numbers, which are stored as steps."""
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *(c for columns, _ in found for c in columns)])).astype(np.int64)
    parts = [zipped(b"\n".join(texts[i] for i in used.tolist()))]
    for columns, n in found:
        places = [np.searchsorted(used, c).astype(np.uint32) for c in columns]
        parts.append(pack(*(np.diff(c, prepend=np.uint32(0)) if j < 2 else c for j, c in enumerate(places)), n.astype(np.uint32)))
        parts[-1] = bytes([len(columns)]) + parts[-1]
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def unpacked_run(data: bytes) -> tuple[list[bytes], list[tuple[list[np.ndarray], np.ndarray]]]:
    parts, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    found = []
    for part in parts[1:]:
        *columns, n = unpack(part[1:], *[np.uint32] * (part[0] + 1))
        found.append(([np.cumsum(c, dtype=np.uint32) if j < 2 else c for j, c in enumerate(columns)], n))
    return unpacked(parts[0]).split(b"\n"), found


def word_hashes(lang: str, words: list[bytes]) -> bytes:
    salt = hashlib.blake2b(lang.encode("utf-8", "surrogatepass")).digest()
    return b"".join(hashlib.blake2b(w, digest_size=8, key=salt).digest() for w in words)


def cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes * _FACTORS[1] >> np.uint64(64 - bits)).astype(np.int64)


def due(since: np.ndarray, scan: int, shards: int) -> np.ndarray:
    """Whether phrases active since these scans (0: not yet) are counted in this one."""
    since = since.astype(np.int64)
    return (since > 0) & (since <= scan) & (scan < since + shards)


_BLOCK_SQL = "shard int, lang string, words binary, ids binary"


def word_blocks(rows: DataFrame, shards: int) -> DataFrame:
    """Texts of CHUNK_BYTES together, by language, as numbers of words: ``words`` (a line each) and ``ids`` in
    order with _BREAK between pieces. A task deals its blocks to the shards in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {}
        turn = TaskContext.get().partitionId()

        def block(lang: str) -> pa.RecordBatch:
            nonlocal turn
            words, pieces = Words(), [np.zeros(0, np.int32)]
            for text in waiting.pop(lang)[1]:
                for part in split_words(text.translate(_PLAIN).replace(b"\n", b" \n ") + b" \n ", keep=True):
                    pieces.append(np.fromiter(map(words.__getitem__, part), np.int32, len(part)))
            ids = np.concatenate(pieces)
            turn += 1
            # Words hold no line feed; the two marks at their head have numbers but no text.
            row = [[turn % shards], [lang], [zipped(b"\n".join(words.texts[2:]))], [pack(ids[ids != _NOTHING].astype(np.uint32))]]
            kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(x, k) for x, k in zip(row, kinds)], names=["shard", "lang", "words", "ids"])

        total = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                held = waiting.setdefault(lang, [0, []])
                held[0] += len(text) + 64
                held[1].append(text)
                total += len(text) + 64
                if total > CHUNK_BYTES:
                    largest = max(waiting, key=lambda x: waiting[x][0])
                    total -= waiting[largest][0]
                    yield block(largest)
        for lang in list(waiting):
            yield block(lang)

    return rows.mapInArrow(run, _BLOCK_SQL)


def counted(ids: np.ndarray, texts: list[bytes], hashes: np.ndarray, since: np.ndarray, bits: int, scan: int, shards: int, longest: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """By length the phrases of a block that are due in this scan, as the word numbers of each place, their counts and
    cells."""
    if scan <= shards:
        n = np.bincount(ids, minlength=len(texts))
        n[_BREAK] = 0
        at = np.flatnonzero(n)
        yield [at], n[at], cell(hashes[at], bits)
    started = since[cell(hashes, bits)]
    started[_BREAK] = 0
    begun, whole = started[ids], hashes[ids]  # of the phrase that begins at each place: its stamp (0: none) and hash
    for length in range(2, longest + 1):
        # A phrase is active by its two neighbours among the shorter ones: at the same place and at the next.
        at = np.flatnonzero((begun[:-1] > 0) & (begun[1:] > 0))
        if not len(at):
            return
        active, joint = np.maximum(begun[at], begun[at + 1]), extended(whole[at], hashes[ids[at + length - 1]])
        now = due(active, scan, shards)
        spots = at[now]
        if len(spots):
            key = ids[spots].astype(np.int64)
            for j in range(1, length):
                key = (np.unique(key, return_inverse=True)[1] if j > 1 else key) * len(texts) + ids[spots + j]
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            yield [ids[spots[first] + j].astype(np.int64) for j in range(length)], n, cell(joint[now][first], bits)
        stamps = since[cell(joint, bits)]
        begun, whole = np.zeros(len(begun) - 1, np.uint8), np.zeros(len(begun) - 1, np.uint64)
        begun[at] = np.where(stamps > 0, np.maximum(stamps, active), 0)  # a shared cell may be ahead of its phrase
        whole[at] = joint


_ROW = pa.schema([("lang", pa.string()), ("total", pa.int64()), ("run", pa.binary()), ("part", pa.int32()), ("data", pa.binary())])
_ROW_SQL = "lang string, total long, run binary, part int, data binary"


def scan_shard(shard: DataFrame, since: bytes, bits: int, scan: int, shards: int, longest: int) -> DataFrame:
    """Counts of the phrases that are due, a run per block, with the block's words where they are counted (``total``),
    and the task's table of cells (``part``, ``data``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamps, sums = unzipped(since, 1 << bits), np.zeros(2 << bits, np.uint8)
        for batch in batches:
            for lang, words, ids in zip(*(batch.column(c) for c in ("lang", "words", "ids"))):
                texts = [b"\n", b"", *unpacked(words.as_py()).split(b"\n")]
                block = unpack(ids.as_py(), np.uint32)[0].astype(np.int32), texts, np.frombuffer(word_hashes(lang.as_py(), texts), np.uint64)
                found, total = [], 0
                for columns, n, cells in counted(*block, stamps, bits, scan, shards, longest):
                    add_capped(sums, cells + ((1 << bits) if len(columns) == longest else 0), n)
                    found.append((columns, n))
                    total += int(n.sum()) if len(columns) == 1 else 0
                if found:
                    row = [lang.as_py(), total, packed_run(found, texts), None, None]
                    yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _ROW)], schema=_ROW)
        pa.default_memory_pool().release_unused()
        for sent in table_parts(sums):
            rows = sent.num_rows
            yield pa.record_batch([pa.nulls(rows, f.type) for f in list(_ROW)[:3]] + sent.columns, schema=_ROW)

    return shard.mapInArrow(run, _ROW_SQL)


def add_capped(sums: np.ndarray, cells: np.ndarray, n: np.ndarray) -> None:
    at, place = np.unique(cells, return_inverse=True)
    sums[at] = np.minimum(sums[at] + np.bincount(place.reshape(-1), np.minimum(n, 255), len(at)), 255)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``phrase``, ``size`` and ``n`` of every phrase with at least ``least`` occurrences whose subphrases
    have as many; and ``lang`` and ``n``, all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = min(CELL_BITS[1], max(CELL_BITS[0], total.bit_length() - 4))
    home = fresh_path(spark, "shards")
    word_blocks(rows, shards).write.partitionBy("shard").parquet(home)
    written, progress = spark.read.schema("lang string, words binary, ids binary, shard int").parquet(home), Progress(bits)
    home_of_runs = fresh_path(spark, "phrases")
    for scan in range(1, longest * shards + 1):
        shard = written.filter(F.col("shard") == (scan - 1) % shards).drop("shard")
        path = f"{home_of_runs}/scan={scan}"
        rows = scan_shard(shard, packed(progress.shorter()), bits, scan, shards, longest).withColumn("cells", F.col("part").isNotNull())
        rows.write.partitionBy("cells").option("compression", "zstd").parquet(path)
        cells = spark.read.schema("part int, data binary, cells boolean").parquet(path).filter("cells").select("part", "data")
        progress.add(gather_parts(cells, 2 << bits, "sum"), scan, least)
        del cells
        remove_path(spark, f"{path}/cells=true")
        drop_exchanges(spark)
        if scan >= shards and not (progress.shorter() > scan + 1 - shards).any():
            break  # whatever became active has seen every shard
    remove_path(spark, home)
    # Tasks that read more runs join more of them, as many as there are ranges.
    every = spark.read.schema("lang string, total long, run binary, scan int, cells boolean").parquet(home_of_runs).filter("run IS NOT NULL")
    sizes = settled(every.groupBy("lang").agg(F.sum("total").alias("n")))
    ranges, slices, counts = 1 + total // RANGE_BYTES, 1 + int(SLICES * progress.full()), []
    for part in range(slices):
        dealt = every.select("lang", "run").coalesce(ranges).mapInArrow(dealt_runs(packed(progress.since), bits, longest, slices * -(-ranges // slices), part, slices), "range int, lang string, run binary")
        exact = dealt.groupBy("range").applyInArrow(whole_range(least, longest), "lang string, phrase string, n long")
        counts.append(settled(exact.select("lang", "phrase", "n", F.size(F.split("phrase", " ")).alias("size"))))
        del dealt, exact
    remove_path(spark, home_of_runs)
    return reduce(DataFrame.unionByName, counts), sizes


def going_on(lang: str, words: list[bytes], found: list, reached: np.ndarray, bits: int, longest: int, part: int, slices: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """By length the phrases of a run whose cell reached the threshold and that are of this slice, as the word numbers of
    each place, their counts and hashes."""
    hashes = np.frombuffer(word_hashes(lang, words), np.uint64)
    for columns, n in found:
        whole = reduce(extended, [hashes[c] for c in columns])
        kept = reached[cell(whole, bits) + ((1 << bits) if len(columns) == longest else 0)]
        if slices > 1:
            kept &= whole % np.uint64(slices) == np.uint64(part)
        at = np.flatnonzero(kept)
        if len(at):
            yield [c[at] for c in columns], n[at], whole[at]


def joined(runs: list[tuple[list[bytes], list]]) -> tuple[list[bytes], list]:
    """Several runs as one: their words, and by length each phrase once, in order of its numbers, with the sum of its
    counts and its hash."""
    words = pa.chunked_array([pa.array(x, pa.binary()) for x, _ in runs]).combine_chunks().dictionary_encode()
    numbers = np.split(words.indices.to_numpy().astype(np.int64), np.cumsum([len(x) for x, _ in runs])[:-1])
    texts, by_length, out = words.dictionary.to_pylist(), {}, []
    for own, (_, found) in zip(numbers, runs):
        for columns, n, whole in found:
            by_length.setdefault(len(columns), []).append(([own[c] for c in columns], n, whole))
    for _, found in sorted(by_length.items()):
        columns = [np.concatenate(x) for x in zip(*(columns for columns, _, _ in found))]
        n, whole = (np.concatenate([x[i] for x in found]) for i in (1, 2))
        key = columns[0]
        for j, column in enumerate(columns[1:]):
            key = (np.unique(key, return_inverse=True)[1] if j else key) * len(texts) + column
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        out.append(([c[first] for c in columns], np.bincount(of, n, len(first)).astype(np.int64), whole[first]))
    return texts, out


def dealt_runs(since: bytes, bits: int, longest: int, ranges: int, part: int, slices: int):
    """A function for ``mapInArrow``: the runs a task reads, joined by language (DEAL_ROWS at a time), as one smaller run
    for every range of the slice that phrases fall into. Phrases whose cell did not reach the threshold are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, held, rows = unzipped(since, 2 << bits) > 0, {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                texts, found = joined(held.pop(lang))
                dealt = []
                for columns, n, whole in found:
                    where = (whole % np.uint64(ranges)).astype(np.int32)
                    order = np.argsort(where, kind="stable")
                    dealt.append((columns, n, np.split(order, np.searchsorted(where[order], np.arange(1, ranges)))))
                for k in range(part, ranges, slices):
                    own = [([c[places[k]] for c in columns], n[places[k]]) for columns, n, places in dealt if len(places[k])]
                    if own:
                        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([lang], pa.string()), pa.array([packed_run(own, texts)], pa.binary())], names=["range", "lang", "run"])

        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("run")):
                words, found = unpacked_run(data.as_py())
                kept = list(going_on(lang, words, found, reached, bits, longest, part, slices))
                if kept:
                    held.setdefault(lang, []).append((words, kept))
                    rows += sum(len(n) for _, n, _ in kept)
                if rows > DEAL_ROWS:
                    yield from flush()
                    rows = 0
        yield from flush()
        pa.default_memory_pool().release_unused()

    return run


def whole_range(least: int, longest: int):
    """A function for ``applyInArrow``: the runs of a range as rows, one for each phrase with at least ``least``
    occurrences."""

    def run(table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), *(pa.Table.from_batches([x]) for x in summed_runs(b"", 0, longest, 0, 1)(table.select(["lang", "run"]).to_batches()))])
        sums = rows.group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])
        return sums.filter(pc.greater_equal(sums["n"], least))

    return run


def summed_runs(since: bytes, bits: int, longest: int, part: int, slices: int):
    """A function for ``mapInArrow``: the runs a task reads as rows, one per language and phrase unless there are more
    than MERGE_ROWS. Phrases whose cell did not reach the threshold, and those of other slices, are left out; without
    cells (``since`` empty) all are rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = unzipped(since, 2 << bits) > 0 if since else None
        held: dict[str, list[pa.Table]] = {}
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (table,) in held.items():
                fixed = pa.table({"lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(len(table), np.int64))), "phrase": table["phrase"], "n": table["n"]})
                yield from fixed.to_batches(max_chunksize=1 << 16)

        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("run")):
                words, found = unpacked_run(data.as_py())
                texts = pa.array(words, pa.binary()).cast(pa.string())
                if reached is not None:
                    found = [x[:2] for x in going_on(lang, words, found, reached, bits, longest, part, slices)]
                for columns, n in found:
                    phrases = pc.binary_join_element_wise(*[texts.take(pa.array(c)) for c in columns], " ")
                    held.setdefault(lang, []).append(pa.table({"phrase": phrases, "n": n.astype(np.int64)}))
                    rows += len(n)
                    if rows > MERGE_ROWS:
                        held = {x: [summed(tables)] for x, tables in held.items()}
                        rows = sum(len(table) for (table,) in held.values())
                        if 2 * rows > MERGE_ROWS:
                            yield from flush()
                            held, rows = {}, 0
        held = {x: [summed(tables)] for x, tables in held.items()}
        yield from flush()
        pa.default_memory_pool().release_unused()

    return run


def summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("phrase", use_threads=False).aggregate([("n", "sum")]).select(["phrase", "n_sum"]).rename_columns(["phrase", "n"])


def best_of_task(kept: int):
    """A function for ``mapInArrow``: the best ``kept`` phrases per language among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, pa.Table] = {}

        def best(table: pa.Table) -> pa.Table:
            return table.sort_by([("score", "descending"), ("a", "descending"), ("phrase", "ascending")]).slice(0, kept).combine_chunks()

        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                own = pa.Table.from_batches([batch]).filter(pc.equal(batch.column("lang"), lang))
                held[lang] = pa.concat_tables([held[lang], own]) if lang in held else own
                if len(held[lang]) > 8 * kept:
                    held[lang] = best(held[lang])
        for table in held.values():
            yield from best(table).to_batches()

    return run


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, within_percent: int = WITHIN_PERCENT, kept: int = KEPT, shards: int = SHARDS) -> DataFrame:
    """The best ``kept`` phrases per language: ``lang``, ``rank``, ``phrase``, ``a`` (its occurrences), ``l`` and ``r``
    (those of the two parts at its weakest cut), ``n`` (words of the language) and ``score``. A null text is empty, a
    null language ``und``; a row counts as often as it is there, with or without a doc_id. Only ``text`` and ``lang``
    are read."""
    counts, sizes = phrase_counts(docs, least, longest, shards)
    words = F.split("phrase", " ")
    found = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("w"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "a", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("one"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("two"))
    side = lookup_side(counts.filter(F.col("size") < longest).select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("n").alias("f")))

    def looked_up(rows: DataFrame, column: str, into: str) -> DataFrame:
        return rows.join(side, (F.col("lang") == F.col("of")) & (F.col(column) == F.col("part"))).withColumn(into, F.col("f")).drop("of", "part", "f")

    cuts = looked_up(looked_up(cuts, "one", "l"), "two", "r")
    cuts = cuts.select("lang", F.concat_ws(" ", "one", "two").alias("phrase"), "a", F.size(F.split("one", " ")).alias("k"), "l", "r")
    cuts = cuts.withColumn("score", F.expr("(1000000BD * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))) DIV (CAST(l AS DECIMAL(15, 0)) * CAST(r AS DECIMAL(15, 0)))"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.*").drop("k")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")))))
    longer = found.filter("size > 2").select(F.col("lang").alias("in"), "a", inner.alias("inside")).groupBy("in", "inside").agg(F.max("a").alias("most"))
    left = weakest.join(lookup_side(longer), (F.col("lang") == F.col("in")) & (F.col("phrase") == F.col("inside")), "left")
    left = left.filter(F.col("most").isNull() | (100 * F.col("most") < within_percent * F.col("a"))).drop("in", "inside", "most")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    left = left.select("lang", "phrase", "a", "l", "r", "score").mapInArrow(best_of_task(kept), "lang string, phrase string, a long, l long, r long, score long")
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("place") <= kept)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= kept)
    total = lookup_side(sizes.withColumnRenamed("lang", "in"))
    return ranked.join(total, F.col("lang") == F.col("in")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
