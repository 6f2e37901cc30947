"""Best-fit packing with conflicts.

Items are dealt into shards of bounded size and packed largest first. A shard keeps its open bins ordered by what is
left in them; each bin carries a bitmap of the sources and one of the duplicate clusters it holds. An item goes to the
first bin, from the tightest fit upwards, that has room and neither its source nor its cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import WORD

CAPACITY = 2_048  # words of a bin
SHARD_ITEMS = 4_096  # items of a shard on average
SHARD_BITS = 31  # bins of one shard are numbered below this power of two


def bits_of(labels: list) -> list[int]:
    """A bit for every label that occurs at least twice; a null or single label conflicts with nothing."""
    count: dict = {}
    for x in labels:
        count[x] = count.get(x, 0) + 1
    number: dict = {}
    return [1 << number.setdefault(x, len(number)) if x is not None and count[x] > 1 else 0 for x in labels]


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each item and its offset there. Items must come largest first and fit a bin."""
    source_bits, cluster_bits = bits_of(sources), bits_of(clusters)
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ordered
    held: list[list[int]] = []  # bitmaps of each bin
    bins, offsets = [], []
    smallest = min(sizes, default=0)
    for size, source, cluster in zip(sizes, source_bits, cluster_bits):
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            masks = held[open_bins[at][1]]
            if not (masks[0] & source or masks[1] & cluster):
                break
            at += 1
        if at < len(open_bins):
            left, number = open_bins.pop(at)
            held[number][0] |= source
            held[number][1] |= cluster
        else:
            left, number = capacity, len(held)
            held.append([source, cluster])
        bins.append(number)
        offsets.append(capacity - left)
        if left - size >= smallest:
            insort(open_bins, (left - size, number))
    return bins, offsets


_OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int64())])


def pack_items(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``n_words``, ``bin_id`` and ``bin_offset`` of every piece of ``items``
    (doc_id, n_words, source, cluster).

    What is longer than a bin is cut: full pieces have a bin each, the rest is packed. No bin holds two items of one
    source or one cluster; nulls conflict with nothing. An item without words gets one row without a bin. Repeated
    rows are packed each. Shards are dealt by hash, so a busy source is spread evenly; ties in size go by doc_id."""
    known = items.select("doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    shards = max(1, -(-known.count() // shard_items))
    dealt = known.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "n_words"), F.lit(shards)))

    def run(key, table):
        rows = sorted(zip(*(table[c].to_pylist() for c in ("n_words", "doc_id", "source", "cluster"))), key=lambda r: (-(r[0] % capacity), r[1] is None, r[1] or 0, r[3] or "", r[2] or ""))
        base, out = key[0].as_py() << SHARD_BITS, []
        rest = [r for r in rows if r[0] % capacity]
        bins, offsets = pack([r[0] % capacity for r in rest], [r[2] for r in rest], [r[3] for r in rest], capacity)
        for (n, doc_id, _, _), number, offset in zip(rest, bins, offsets):
            out.append((doc_id, n // capacity, n - n % capacity, n % capacity, base + number, offset))
        number = max(bins, default=-1) + 1
        for n, doc_id, _, _ in rows:
            for piece in range(n // capacity):
                out.append((doc_id, piece, piece * capacity, capacity, base + number, 0))
                number += 1
            if not n:
                out.append((doc_id, 0, 0, 0, None, None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece long, start long, n_words long, bin_id long, bin_offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Packs texts by words; texts with equal digests are a cluster. Only numbers and labels are shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("n_words"), F.col("source").alias("source"), F.md5(text).alias("cluster"))
    return pack_items(items, capacity, shard_items)
