"""Work that depends on the order of rows inside a key, without putting a hot key into one task.

Three greedy operators (threshold rules, sequence rules, first-per-window decisions) reduce to one
question. Every candidate row is an interval ``[start, reach]`` on the order of its key; take the first,
skip all rows it covers, take the next, and so on. Two ways answer it:

* :func:`pick_in_order` for ordinary keys: one shuffle on the key, a sort, and one pass with constant
  state over Arrow batches. Payload columns pass through untouched.
* :func:`pick_hot` for keys above ``hot_rows``: the key's rows are cut into chunks of bounded size. Each
  chunk is contracted to the few intervals an outside reach can lead to, the contracted intervals are
  solved the same way, and their answer gives every chunk its entry state. The result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions.names import free, hidden
from ravelin.session import materialise

HOT_ROWS = 2_000_000
CHUNK_ROWS = 200_000
FAN = 16
SLABS = 128
SLAB_ROWS = 100_000
SAMPLED_ROWS = 20_000
SEED = 7
FAR = 2**62
AT = "ordered_at"
START, REACH = ("start_a", "start_b"), ("reach_a", "reach_b")
#: Columns that decisions per window add meanwhile; a caller's columns of these names are set aside.
RESERVED = {AT, *START, *REACH, "place", "alone", "rn", "slab", "spread", "hot_n", "n", "size_rn", "offset_rn", "entry_a", "entry_b", *(f"chunk_{i}" for i in range(9))}


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], place: str = "place") -> DataFrame:
    """Each key in one partition and in order, with ``place`` counting from 1.

    A window asks for the placement, so adaptive execution keeps it. A bare ``repartition`` may be merged
    with the exchange of a join below it, which can then be read map by map once the join broadcasts.
    """
    along = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(place, F.row_number().over(along))


def pick_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    picker: Callable[[], Callable[..., bool]],
    flag: str | None = None,
) -> DataFrame:
    """Run ``picker()`` over each key's rows in order and keep the rows for which it says yes.

    ``picker`` makes a function of ``(new_key, *input values)``. With ``flag`` all rows are kept and the
    answer becomes a boolean column.
    """
    names, input_names, keep_all = df.columns, list(inputs), flag is not None
    (number,) = free(df, "place")
    schema = T.StructType(list(df.schema.fields) + ([T.StructField(flag, T.BooleanType())] if keep_all else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = picker()
        for batch in batches:
            values = zip(*[batch.column(name).to_pylist() for name in (number, *input_names)])
            mask = pa.array([decide(place == 1, *row) for place, *row in values], pa.bool_())
            columns = [batch.column(name) for name in names]
            if keep_all:
                yield pa.RecordBatch.from_arrays([*columns, mask], [*names, flag])
            else:
                kept = pa.RecordBatch.from_arrays(columns, names).filter(mask)
                if kept.num_rows:
                    yield kept

    return in_order(df, keys, order, number).mapInArrow(run, schema)


def interval_picker() -> Callable[..., bool]:
    """Greedy choice of intervals; ``entry`` is the reach the key already has before its first row."""
    reach = (-FAR, -FAR)

    def decide(new_key, start_a, start_b, reach_a, reach_b, entry_a=-FAR, entry_b=-FAR):
        nonlocal reach
        if new_key:
            reach = (entry_a, entry_b)
        if (start_a, start_b) <= reach:
            return False
        reach = (reach_a, reach_b)
        return True

    return decide


def sample_fraction(hot_rows: int) -> float:
    """A key at the limit shows about ``SAMPLED_ROWS`` times in the sample, so half of that is a safe test."""
    return min(1.0, SAMPLED_ROWS / hot_rows)


def hot_keys(
    df: DataFrame, keys: Sequence[str], ts: str, hot_rows: int | None, sample: DataFrame | None = None
) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, with their count, or ``None``.

    Candidates come from a sample (``sample`` when the caller can take it earlier), so keys that are nearly
    unique cause no second full shuffle; only candidates are counted in full. The answer decides how a key
    is computed, never what comes out. There are at most ``rows / hot_rows`` hot keys and twice as many
    candidates, which bounds every broadcast of them.
    """
    if hot_rows is None:
        return None
    fraction = sample_fraction(hot_rows)
    looked = sample if sample is not None else (df.sample(fraction, SEED) if fraction < 1 else df)
    floor = hot_rows * fraction / 2 if fraction < 1 else hot_rows
    counted = F.count(F.lit(1)).alias("hot_n")
    candidates = looked.groupBy(*keys).agg(counted).filter(F.col("hot_n") > floor).select(*keys)
    if candidates.isEmpty():
        return None
    hot = (
        df.join(F.broadcast(candidates), list(keys), "left_semi")
        .groupBy(*keys)
        .agg(counted)
        .filter(F.col("hot_n") > hot_rows)
    )
    hot = materialise(hot)
    return None if hot.isEmpty() else hot


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ordinary keys and the rows of hot keys."""
    names = F.broadcast(hot.select(*keys))
    return df.join(names, list(keys), "left_anti"), df.join(names, list(keys), "left_semi")


def slab_count(rows: int, hot_rows: int) -> int:
    return max(1, min(math.ceil(2 * rows / hot_rows), max(SLABS, math.ceil(rows / SLAB_ROWS))))


def rank_hot(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    hot: DataFrame,
    hot_rows: int,
    counted: Sequence[str] = (),
) -> DataFrame:
    """``rn``, the row number inside each hot key, and a running count of each boolean in ``counted``.

    Rows are cut into slabs by ranges of their content, ``(key, ts, tie)`` and a hash, so a burst is split like an
    even spread: a slab holds about half of ``hot_rows``, or up to ``SLAB_ROWS`` where more than ``SLABS`` would be
    needed, so that a low ``hot_rows`` makes no more tasks than the rows are worth. Rows are numbered inside a slab and
    shifted by the sizes of the key's slabs before it. The offsets have at most one row per key and slab. The slabs are checkpointed, as
    ranges are sampled and must not change. ``ts`` must not be null.
    """
    keys = list(keys)
    parts = slab_count(hot.agg(F.sum("hot_n")).first()[0], hot_rows)
    plain = [c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]
    spread = df.withColumn("spread", F.xxhash64(*plain)).repartitionByRange(parts, *keys, ts, *tie, "spread")
    slabbed = materialise(spread.withColumn("slab", F.spark_partition_id().cast("bigint")))
    sizes = slabbed.groupBy(*keys, "slab").agg(
        F.count(F.lit(1)).alias("size_rn"),
        *[F.sum(F.col(c).cast("bigint")).alias(f"size_{c}") for c in counted],
    )
    before = Window.partitionBy(*keys).orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    measures = ["rn", *counted]
    offsets = sizes.select(
        *keys, "slab", *[F.coalesce(F.sum(f"size_{m}").over(before), F.lit(0)).alias(f"offset_{m}") for m in measures]
    )
    inside = Window.partitionBy(*keys, "slab").orderBy(ts, *tie, "spread")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = slabbed.withColumn("rn", F.row_number().over(inside).cast("bigint"))
    for name in counted:
        local = local.withColumn(f"n_{name}", F.sum(F.col(name).cast("bigint")).over(running))
    placed = local.join(F.broadcast(offsets), [*keys, "slab"]).withColumn("rn", F.col("rn") + F.col("offset_rn"))
    for name in counted:
        placed = placed.withColumn(f"n_{name}", F.col(f"n_{name}") + F.col(f"offset_{name}"))
    return materialise(placed.drop("slab", "spread", *[f"offset_{m}" for m in measures]))


def _contract(nodes: DataFrame, keys: Sequence[str], chunk: str) -> DataFrame:
    """Each chunk as the intervals an outside reach can meet.

    From a row of the chunk the greedy path leaves the chunk with some final reach. Rows with the same
    final reach fold into one interval, whose start is the last of them. Reaches grow along the order, so
    the path enters at the latest with the first row beyond the reach of the chunk's first row; rows after
    that one are no entries.
    """
    group = [*keys, chunk]
    fields = [nodes.schema[c] for c in group] + [T.StructField(c, T.LongType()) for c in (*START, *REACH)]
    schema = T.StructType(fields)
    arrow_names = [f.name for f in fields]

    def fold(rows: list[tuple]) -> list[tuple]:
        finals: list[tuple] = [()] * len(rows)
        following = len(rows)
        for i in range(len(rows) - 1, -1, -1):
            reach = rows[i][2:]
            while following > i + 1 and rows[following - 1][:2] > reach:
                following -= 1
            finals[i] = reach if following == len(rows) else finals[following]
        entries = min(following + 1, len(rows))
        return [
            (*rows[i][:2], *finals[i]) for i in range(entries) if i + 1 == entries or finals[i] != finals[i + 1]
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, arrow_types = None, [], None

        def flush():
            folded = fold(rows)
            columns = list(zip(*[(*current, *piece) for piece in folded]))
            arrays = [pa.array(values, kind) for values, kind in zip(columns, arrow_types)]
            return pa.RecordBatch.from_arrays(arrays, arrow_names)

        for batch in batches:
            arrow_types = [batch.schema.field(name).type for name in arrow_names]
            places = batch.column("place").to_pylist()
            group_rows = zip(*[batch.column(name).to_pylist() for name in group])
            value_rows = zip(*[batch.column(name).to_pylist() for name in (*START, *REACH)])
            for place, group_row, values in zip(places, group_rows, value_rows):
                if place == 1:
                    if rows:
                        yield flush()
                    current, rows = group_row, []
                rows.append(values)
        if rows:
            yield flush()

    return in_order(nodes.select(*group, *START, *REACH), group, START).mapInArrow(run, schema)


def _following(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each interval the start of the first one beyond its reach, as ``next_a, next_b``; without one no row.

    Starts and reaches are laid on one line that is cut by ranges; what lies beyond a range is carried over as
    one row per key and range.
    """
    keys = list(keys)
    own = F.struct(*[F.col(c) for c in START])
    starts = nodes.select(*keys, F.col("start_a").alias("a"), F.col("start_b").alias("b"), F.lit(0).alias("side"), own.alias("own"))
    reaches = nodes.select(*keys, F.col("reach_a").alias("a"), F.col("reach_b").alias("b"), F.lit(1).alias("side"), own.alias("own"))
    line = starts.unionByName(reaches).repartitionByRange(*keys, "a", "b", "side")
    line = materialise(line.withColumn("slab", F.spark_partition_id()).withColumn("start", F.when(F.col("side") == 0, F.col("own"))))
    back = Window.partitionBy(*keys).orderBy(F.desc("slab")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = line.groupBy(*keys, "slab").agg(F.min("start").alias("first"))
    beyond = beyond.select(*keys, "slab", F.last("first", ignorenulls=True).over(back).alias("beyond"))
    inside = Window.partitionBy(*keys, "slab").orderBy(F.desc("a"), F.desc("b"), F.desc("side"))
    seen = line.withColumn("near", F.last("start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    found = seen.filter("side = 1").join(beyond, [*keys, "slab"]).withColumn("to", F.coalesce("near", "beyond"))
    found = found.filter("to IS NOT NULL")
    return found.select(*keys, *[F.col(f"own.{c}") for c in START], F.col("to.start_a").alias("next_a"), F.col("to.start_b").alias("next_b"))


def _jump(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The taken intervals by pointer doubling, for windows that cover so many rows that chunks do not contract.

    Every interval points to the next that would be taken after it. Each round follows the pointers of all taken
    intervals and then doubles the pointers, so the rounds grow with the logarithm of the taken intervals.
    """
    keys = list(keys)
    pointers = materialise(_following(nodes, keys))
    first = F.min(F.struct(*[F.col(c) for c in START]))
    taken = nodes.groupBy(*keys).agg(first.alias("at")).select(*keys, "at.*")
    while True:
        reached = materialise(taken.join(pointers, [*keys, *START]).select(*keys, *[F.col(f"next_{c[-1]}").alias(c) for c in START]))
        if reached.isEmpty():
            return nodes.join(taken, [*keys, *START], "left_semi")
        taken = materialise(taken.unionByName(reached))
        ahead = pointers.select(*keys, F.col("start_a").alias("next_a"), F.col("start_b").alias("next_b"), F.col("next_a").alias("far_a"), F.col("next_b").alias("far_b"))
        pointers = materialise(pointers.join(ahead, [*keys, "next_a", "next_b"]).select(*keys, *START, F.col("far_a").alias("next_a"), F.col("far_b").alias("next_b")))


def _with_entries(nodes: DataFrame, taken: DataFrame, keys: Sequence[str], chunk: str, keep_all: bool) -> DataFrame:
    """Give each chunk the reach it is entered with; a chunk nothing is taken from has no entry."""
    along = Window.partitionBy(*keys).orderBy(chunk)
    entries = taken.select(
        *keys,
        chunk,
        F.coalesce(F.lag("reach_a").over(along), F.lit(-FAR)).alias("entry_a"),
        F.coalesce(F.lag("reach_b").over(along), F.lit(-FAR)).alias("entry_b"),
    )
    joined = nodes.join(entries, [*keys, chunk], "left" if keep_all else "inner")
    return joined.fillna(FAR, ["entry_a", "entry_b"])


def pick_hot(
    nodes: DataFrame,
    keys: Sequence[str],
    position: str,
    flag: str | None = None,
    hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    _level: int = 0,
) -> DataFrame:
    """Greedy intervals of hot keys. ``position`` is a rank inside the key; chunks hold ``chunk_rows``."""
    keys, chunk = list(keys), f"chunk_{_level}"
    width = chunk_rows if _level == 0 else FAN
    chunked = nodes.withColumn(chunk, F.floor(F.col(position) / width).cast("bigint"))
    pieces = materialise(_contract(chunked, keys, chunk))
    sizes = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    wide = pieces.groupBy(*keys, F.floor(F.col(chunk) / FAN)).agg(F.count(F.lit(1)).alias("n"))
    inputs = [*START, *REACH]
    if (sizes.agg(F.max("n")).head()[0] or 0) <= hot_rows:
        taken = pick_in_order(pieces, keys, START, inputs, interval_picker)
    elif (wide.agg(F.max("n")).head()[0] or 0) <= hot_rows:
        taken = pick_hot(pieces, keys, chunk, None, hot_rows, chunk_rows, _level + 1)
    else:
        taken = _jump(pieces, keys)
    entered = _with_entries(chunked, taken.select(*keys, chunk, *REACH), keys, chunk, flag is not None)
    picked = pick_in_order(
        entered, [*keys, chunk], START, [*inputs, "entry_a", "entry_b"], interval_picker, flag
    )
    return picked.drop(chunk, "entry_a", "entry_b")


def first_per_window(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    window_micros: int,
    inclusive: bool,
    flag: str = "kept",
    hot_rows: int | None = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Mark the first row per key, and each next one once the window after the last marked row is over.

    ``ts`` is a bigint of microseconds. ``inclusive`` windows still cover a row exactly ``window`` later.
    A covered row does not renew the window. A row without time counts as at time zero, on every path. Other
    columns may have any names; they come out as they were.
    """
    df, name, back = hidden(df, RESERVED)
    keys, ts, tie = [name(k) for k in keys], name(ts), [name(t) for t in tie]
    span = window_micros if inclusive else window_micros - 1

    def picker():
        until = None

        def decide(new_key, now):
            nonlocal until
            if new_key or until is None or now > until:
                until = now + span
                return True
            return False

        return decide

    columns = df.columns
    df = df.withColumn(AT, F.coalesce(F.col(ts), F.lit(0)))
    hot = hot_keys(df, keys, AT, hot_rows)
    if hot is None:
        return back(_first_ordinary(df, keys, tie, span, picker, flag), flag)
    cold, warm = split_hot(df, keys, hot)
    ranked = rank_hot(warm, keys, AT, tie, hot, hot_rows)
    nodes = ranked.select(
        *columns,
        "rn",
        F.col(AT).alias("start_a"),
        F.col("rn").alias("start_b"),
        (F.col(AT) + span).alias("reach_a"),
        F.lit(FAR).alias("reach_b"),
    )
    marked = pick_hot(nodes, keys, "rn", flag, hot_rows, chunk_rows).select(*columns, flag)
    return back(_first_ordinary(cold, keys, tie, span, picker, flag).select(*columns, flag).unionByName(marked), flag)


def _first_ordinary(df: DataFrame, keys: list[str], tie: Sequence[str], span: int, picker, flag: str) -> DataFrame:
    """A row with no other within the window on either side is first by a lag and a lead alone; only the others
    take the ordered pass. Both read one exchange."""
    along = Window.partitionBy(*keys).orderBy(AT, *tie)
    before, after = F.lag(AT).over(along), F.lead(AT).over(along)
    apart = F.coalesce(F.col(AT) - before > span, F.lit(True)) & F.coalesce(after - F.col(AT) > span, F.lit(True))
    seen = df.withColumn("alone", apart)
    alone = seen.filter("alone").drop("alone").withColumn(flag, F.lit(True))
    crowded = seen.filter("NOT alone").drop("alone")
    return alone.unionByName(pick_in_order(crowded, keys, [AT, *tie], [AT], picker, flag))
