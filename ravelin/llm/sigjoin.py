"""MinHash near-duplicates by an inverted join on signature coordinates.

Equal shingle sets are one class. A class is posted under each pair of coordinate and value of its signature; pairs
that collide in ``matches`` of ``COORDINATES`` places become candidates, as many as the threshold allows. Values nobody
shares cannot collide; of the others, ordered from rare to common, a class that shares m needs postings only under its first m - matches + 1, as two
classes with enough collisions share one of these (prefix filter). Each posting list is first joined with its most
central class alone and the confirmed links are contracted; lists then inside one component are skipped, and in the
rest only pairs across components are counted, in pieces, and compared by their lowest hashes. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import WORD_CACHE, batches, fresh_path, materialise, settled
from ravelin.llm.components import components
from ravelin.operators.enrich import lookup_side

SHINGLE = 5
PERCENT = 85  # links have 100 * intersection >= PERCENT * union
COORDINATES = 64
MISSED = 1e-8  # chance at most that a pair at the threshold collides in too few places
LOWEST = 192  # smallest hashes of a set that go along for a first comparison; all of a smaller set
SLACK = 6.5  # standard deviations below the threshold at which a comparison of lowest hashes gives up
PIECE = 1_000  # classes of one list that are compared at once
SPOKES = 500  # texts checked against one copy of a hub's text

_STEP = np.uint64(0xD1342543DE82EF95)
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, COORDINATES, np.uint64)


def matches_for(percent: int) -> int:
    """The most places of which a pair at the threshold misses with a chance of ``MISSED`` at most: 36 at 85 percent,
    31 at 80. A threshold at which such a pair may well collide nowhere is refused."""
    share, missed, m = percent / 100, 0.0, 0
    while m < COORDINATES:
        missed += math.comb(COORDINATES, m) * share**m * (1 - share) ** (COORDINATES - m)
        if missed > MISSED:
            break
        m += 1
    if not m or percent > 100:
        raise ValueError(f"{COORDINATES} coordinates cannot find pairs at {percent} percent")
    return m


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles, in lower case (A-Z)."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            out.append(h)
        hashes = np.array(out, np.uint64)
        size = min(SHINGLE, len(words))
        rolled = np.full(len(words) - size + 1, size, np.uint64)
        for j in range(size):
            rolled *= _STEP
            rolled += hashes[j : j + len(rolled)]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0x94D049BB133111EB)
        rolled ^= rolled >> np.uint64(32)
        return np.unique(rolled)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * _FACTORS + _OFFSETS).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.list_(pa.int32())), ("lowest", pa.list_(pa.int32()))])


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_key`` (a digest of the set), ``signature`` and ``lowest`` (the smallest hashes,
    shortened); null for an empty set."""

    def run(parts):
        shingles = Shingles()

        def each(row):
            found = shingles(row[1])
            if not len(found):
                return [(row[0], 0, None, None, None)]
            return [(row[0], len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), signature(found).view(np.int32), (found[:LOWEST] >> np.uint64(32)).astype(np.uint32).view(np.int32))]

        yield from batches(each, _SIGNED, "doc_id", "text")(parts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature array<int>, lowest array<int>")
    return signed.withColumn("row", F.monotonically_increasing_id())


def postings(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``token``, ``rep``, ``centrality`` and ``mask``, the coordinates of the prefix as bits, for the prefix of every class that shares enough values
    for ``percent``. Arrays here have at most COORDINATES entries."""
    matches = matches_for(percent)
    tokens = classes.select("rep", F.posexplode("signature").alias("place", "value"))
    tokens = tokens.select("rep", (F.col("place").cast("long") * (1 << 32) + F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("token", "shared")
    held = tokens.join(shared, F.col("token") == F.col("shared")).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"), F.sum("n").alias("centrality"))
    held = held.filter(F.size("held") >= matches).withColumn("prefix", F.slice("held", 1, F.size("held") - matches + 1))
    mask = F.expr("aggregate(prefix, 0L, (m, p) -> m | shiftleft(1L, cast(shiftright(p.token, 32) AS int)))")
    return held.select("rep", "centrality", mask.alias("mask"), F.explode("prefix").alias("post")).select(F.col("post.token").alias("token"), "rep", "centrality", "mask")


def star_pairs(posted: DataFrame) -> DataFrame:
    """(a, hub): each class with the most central class of each of its lists."""
    best = F.max(F.struct("centrality", (-F.col("rep")).alias("order")))
    hubs = posted.groupBy("token").agg(best.alias("best")).select(F.col("token").alias("list"), (-F.col("best.order")).alias("hub"))
    pairs = posted.join(hubs, F.col("token") == F.col("list")).filter("rep <> hub")
    return pairs.select(F.col("rep").alias("a"), "hub").distinct()


def runs(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of equal ``keys`` over sorted batches; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for part in parts:
        if not part.num_rows:
            continue
        columns = [part.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(part.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        borders = [0, *np.flatnonzero(change).tolist(), part.num_rows]
        for a, b in zip(borders, borders[1:]):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(part.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def lowest_set(stored: np.ndarray) -> tuple[frozenset, bool]:
    """A stored list of lowest hashes as a set, and whether it may have been cut. The list's own length tells, as
    shortened hashes that agree make the set smaller."""
    return frozenset(stored.view(np.uint32).tolist()), len(stored) >= LOWEST


def may_link(one: tuple[frozenset, bool], two: tuple[frozenset, bool], percent: int) -> bool:
    """False only if the sets of these lowest hashes cannot be linked, for whole sets up to a hash or two that were
    shortened alike, else by SLACK standard deviations of the sample below the smaller of the two largest hashes."""
    a, b = one[0], two[0]
    joint = a & b
    partial = [max(x) for x, cut in (one, two) if cut]
    if not partial:
        return 100 * (len(joint) + 2) >= percent * (len(a) + len(b) - len(joint) - 2)
    border, share = min(partial), percent / 100
    n_joint = sum(x <= border for x in joint)
    n_union = sum(x <= border for x in a) + sum(x <= border for x in b) - n_joint
    return n_joint + 2 >= share * n_union - SLACK * (share * (1 - share) * n_union) ** 0.5


def sketches(signed: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """``rep`` and the named columns of the row that stands for each class."""
    chosen = classes.select("rep", F.col("row").alias("chosen"))
    return signed.select("row", *columns).join(chosen, F.col("row") == F.col("chosen")).select("rep", *columns)


def crossing_pairs(posted: DataFrame, signed: DataFrame, classes: DataFrame, roots: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, hub): pairs of one list in different components that collide in enough places and whose lowest hashes
    allow a link. A list is cut into pieces; each pair of pieces is one small task. A pair is looked at once, in the
    list of the first coordinate that both have in their prefix with the same value."""
    matches = matches_for(percent)
    placed = posted.join(roots, F.col("rep") == F.col("vertex"), "left").select("token", "rep", "mask", F.coalesce("root", "rep").alias("root"))
    mixed = placed.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    mixed = mixed.select(F.col("token").alias("list"), F.ceil(F.col("size") / PIECE).cast("int").alias("pieces"))
    rows = placed.join(mixed, F.col("token") == F.col("list")).withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    asked = classes.join(rows.select(F.col("rep").alias("asked")).distinct(), F.col("rep") == F.col("asked"), "left_semi")
    held = sketches(signed, asked, "signature", "lowest").withColumnRenamed("rep", "owner")
    rows = rows.select("token", "rep", "mask", "root", "piece", other.alias("other")).join(held, F.col("rep") == F.col("owner"))
    rows = rows.select("token", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "piece", "rep", "root", "mask", "signature", "lowest")

    def run(parts):
        bits = np.arange(COORDINATES, dtype=np.uint64)
        for (token, i, j), group in runs(parts, ["token", "i", "j"]):
            rep, root, piece = (group[c].to_numpy() for c in ("rep", "root", "piece"))
            values = group["signature"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
            prefix = (group["mask"].to_numpy().view(np.uint64)[:, None] >> bits & np.uint64(1)).astype(bool)
            lists, sets = group["lowest"], {}
            place = int(token) >> 32
            left, right = np.flatnonzero(piece == i), np.flatnonzero(piece == j)
            found = []
            for a in left.tolist():
                rest = right[(root[right] != root[a]) & ((rep[right] < rep[a]) if i == j else True)]
                if not len(rest):
                    continue
                same = values[rest] == values[a]
                first = (same & prefix[rest] & prefix[a]).argmax(1)
                for b in rest[(first == place) & (same.sum(1) >= matches)].tolist():
                    for x in (a, b):
                        if x not in sets:
                            sets[x] = lowest_set(lists[x].values.to_numpy())
                    if may_link(sets[a], sets[b], percent):
                        found.append((max(rep[a], rep[b]), min(rep[a], rep[b])))
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "hub"])

    keys = ["token", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, hub long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) linked on their full sets. Spokes meet their hub's text in sorted runs; a hub of many spokes
    is copied, once per SPOKES of them, so no run grows with the hub."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id IS NOT NULL AND text IS NOT NULL")
    needed = pairs.select(F.col("a").alias("need")).union(pairs.select("hub")).distinct()
    texts = texts.join(needed, F.col("id") == F.col("need"), "left_semi")
    busy = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SPOKES).cast("int").alias("copies")).filter("copies > 1")
    busy = lookup_side(materialise(busy.withColumnRenamed("hub", "of")))  # one row per SPOKES pairs at most; the rest have one copy
    copies = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(busy, F.col("hub") == F.col("of"), "left").select("a", "hub", F.pmod(F.xxhash64("a"), copies).cast("int").alias("copy"))
    spokes = dealt.join(texts, F.col("a") == F.col("id")).select("hub", "copy", F.lit(1).alias("role"), "a", "text")
    hubs = pairs.select("hub").distinct().join(busy, F.col("hub") == F.col("of"), "left")
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy")).join(texts, F.col("hub") == F.col("id"))
    hubs = hubs.select("hub", "copy", F.lit(0).alias("role"), F.col("hub").alias("a"), "text")

    def run(parts):
        shingles, last, sets = Shingles(), None, []
        for part in parts:
            links = []
            for hub, copy, role, a, text in zip(*(part.column(c).to_pylist() for c in ("hub", "copy", "role", "a")), part.column("text")):
                if (hub, copy) != last:
                    last, sets = (hub, copy), []
                own = shingles(text.as_py())
                if role == 0:
                    sets.append(own)
                    continue
                for other in sets:
                    joint = len(np.intersect1d(own, other, assume_unique=True))
                    if joint and 100 * joint >= percent * (len(own) + len(other) - joint):
                        links.append((a, hub))
                        break
            if links:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    rows = spokes.union(hubs).repartition("hub", "copy").sortWithinPartitions("hub", "copy", "role")
    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` per row of ``docs``. A row without words or without
    a doc_id is linked with nothing; its component is its own doc_id, and it is kept. Rows that share a doc_id are
    judged each by its text; repeated rows get equal results. Signatures, classes, postings and links are
    checkpointed or written, so each text is read once for its signature and once per confirmation if it is a
    candidate. Signatures lie in a table of columns, of which each step reads its own."""
    path = fresh_path(docs.sparkSession, "signatures")
    signatures(docs).write.parquet(path)
    signed = docs.sparkSession.read.parquet(path)
    whole = signed.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "row"))
    classes = settled(whole.groupBy("set_key").agg(first.alias("first")).select("set_key", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row")))
    posted = settled(postings(sketches(signed, classes, "signature"), percent))
    links = settled(confirmed(settled(star_pairs(posted)), docs, percent))
    roots = components(links)
    more = settled(crossing_pairs(posted, signed, classes, roots, percent))
    if not more.isEmpty():
        links = settled(links.union(confirmed(more, docs, percent)))
        roots = components(links)
    named = classes.select(F.col("set_key").alias("class_key"), "rep").join(roots, F.col("rep") == F.col("vertex"), "left")
    named = named.select("class_key", F.coalesce("root", "rep").alias("root"))
    out = signed.join(named, (F.col("set_key") == F.col("class_key")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
