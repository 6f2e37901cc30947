"""Quality score by a factorisation machine.

Features are hashed words, weighed so that a text's words have length one together, and standardised structure
statistics with the stored length. The machine adds a bias, linear weights and low-rank pairwise interactions; the
latter are half of the squared sum minus the sum of squares per factor, so a score is linear in the text's words.
The model is fitted on a bounded sample of labelled rows outside the held-out third.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ravelin.llm.common import WORD_CACHE, batches

FIT_ROWS = 6_000  # the documented bound of the fitting sample: the labelled rows of least hash
BUCKETS = 1 << 15
FACTORS = 8
EPOCHS = 10
BATCH = 100
SEED = 7
THRESHOLD = 0.5
N_STATS = 16

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
_MARKS = b".,;:!?'\"()-"


def _share(data: bytes, what: bytes, size: int) -> float:
    return (len(data) - len(data.translate(None, what))) / size


def structure(data: bytes, words: list[bytes], n_unique: int, n_chars: int | None) -> list[float]:
    size, n = max(1, len(data)), max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    return [
        np.log1p(len(words)),
        np.log1p(len(data)),
        np.log1p(len(data) if n_chars is None else max(0, n_chars)),
        n_unique / n,
        n_unique / np.sqrt(n),
        float(lengths.mean()),
        float(np.log1p(lengths.max())),
        float(lengths.std()),
        _share(data, _UPPER, size),
        _share(data, _DIGITS, size),
        _share(data, _SYMBOLS, size),
        _share(data, _MARKS, size),
        _share(data, b"!", size),
        1 - len(set(lines)) / n_lines,
        np.log1p(n / n_lines),
        sum(1 for x in lines if x[-1:] in b".!?\"'") / n_lines,
    ]


class Features:
    """Words in lower case (ASCII) by bucket, without repeats, and the statistics."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, list[float]]:
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.split()
        distinct = set(data.lower().split())
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        known, out = self.known, set()
        for w in distinct:
            i = known.get(w)
            if i is None:
                i = known[w] = zlib.crc32(w) % BUCKETS
            out.add(i)
        return np.fromiter(sorted(out), np.int32, len(out)), structure(data, words, len(distinct), n_chars)


@dataclass
class Model:
    bias: float
    linear: np.ndarray  # buckets, then statistics
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def stats(self, values) -> np.ndarray:
        return np.clip((np.asarray(values) - self.centre) / self.scale, -4, 4) / np.sqrt(N_STATS)

    def score(self, buckets: np.ndarray, values) -> float:
        x = self.stats(values)
        at = 1 / np.sqrt(max(1, len(buckets)))
        words = self.factors[buckets]
        held = self.factors[BUCKETS:]
        sums = at * words.sum(0) + x @ held
        squares = at * at * np.square(words).sum(0) + np.square(x) @ np.square(held)
        y = self.bias + at * self.linear[buckets].sum() + x @ self.linear[BUCKETS:] + (np.square(sums) - squares).sum() / 2
        return float(1 / (1 + np.exp(-np.clip(y, -35, 35))))


def fit(rows: list[tuple[np.ndarray, list[float], int]]) -> Model:
    """Mini-batches of the log loss with per-weight step sizes; rows in the given order, so a fit is repeatable.
    Without rows the score is 0.5 everywhere."""
    size = BUCKETS + N_STATS
    rng = np.random.default_rng(SEED)
    model = Model(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), np.zeros(N_STATS), np.ones(N_STATS))
    if not rows:
        model.factors[:] = 0
        return model
    values = np.array([r[1] for r in rows])
    model.centre, model.scale = values.mean(0), np.maximum(values.std(0), 1e-6)
    target = np.array([r[2] for r in rows], np.float64)
    share = min(max(target.mean(), 0.01), 0.99)
    model.bias = float(np.log(share / (1 - share)))
    stats = model.stats(values)
    seen, seen_factors = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    stat_places = np.arange(BUCKETS, size)
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            places = np.concatenate([np.concatenate((rows[i][0], stat_places)) for i in part])
            weights = np.concatenate([np.concatenate((np.full(len(rows[i][0]), 1 / np.sqrt(max(1, len(rows[i][0])))), stats[i])) for i in part])
            sizes = np.array([len(rows[i][0]) + N_STATS for i in part])
            row = np.repeat(np.arange(len(part)), sizes)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            scaled = model.factors[places] * weights[:, None]
            sums = np.add.reduceat(scaled, starts)
            y = model.bias + np.add.reduceat(model.linear[places] * weights, starts) + (np.square(sums) - np.add.reduceat(np.square(scaled), starts)).sum(1) / 2
            error = (1 / (1 + np.exp(-np.clip(y, -35, 35))) - target[part]) / len(part)
            model.bias -= 0.5 * error.sum()
            slope = error[row] * weights
            touched, inverse = np.unique(places, return_inverse=True)
            step = np.bincount(inverse, slope, len(touched)) + 1e-6 * model.linear[touched]
            seen[touched] += step * step
            model.linear[touched] -= 0.2 * step / np.sqrt(seen[touched])
            inner = slope[:, None] * (sums[row] - scaled)
            for f in range(FACTORS):
                step = np.bincount(inverse, inner[:, f], len(touched)) + 1e-5 * model.factors[touched, f]
                seen_factors[touched, f] += step * step
                model.factors[touched, f] -= 0.05 * step / np.sqrt(seen_factors[touched, f])
    model.linear, model.factors = model.linear.astype(np.float32), model.factors.astype(np.float32)
    return model


def fold(doc_id):
    """The remainder that sets the held-out third: those with 1 are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 3


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits on at most ``fit_rows`` labelled rows outside the held-out third. Only their ids are joined to the texts,
    and that side is bounded by ``fit_rows``, so it is broadcast. Labels that are null, not 0 or 1, or contradict
    each other for a document are left out; a ``doc_id`` with several texts teaches with the least one."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(fold(F.col("doc_id")) != 1)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).filter("label = top").drop("top")
    wanted = [tuple(r) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()]
    chosen = docs.sparkSession.createDataFrame(wanted, "wanted long, label int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("wanted"))
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("buckets", pa.list_(pa.int32())), ("stats", pa.list_(pa.float64()))])

    def run(parts):
        features = Features()
        yield from batches(lambda r: [(r[0], r[1], *features(r[2], r[3]))], schema, "doc_id", "label", "text", "n_chars")(parts)

    got = rows.select("doc_id", "label", "text", "n_chars").mapInArrow(run, "doc_id long, label int, buckets array<int>, stats array<double>").toArrow()
    sample: dict[int, tuple] = {}
    for doc_id, label, buckets, stats in zip(got["doc_id"].to_pylist(), got["label"].to_pylist(), got["buckets"], got["stats"].to_pylist()):
        one = (buckets.values.to_numpy(), stats, label)
        if doc_id not in sample or (stats, len(one[0])) < (sample[doc_id][1], len(sample[doc_id][0])):
            sample[doc_id] = one
    return fit([sample[k] for k in sorted(sample)])


def score(docs: DataFrame, model: Model, text: str = "text", n_chars: str = "n_chars", into: str = "quality_score") -> DataFrame:
    """All rows and columns of ``docs`` with the score as ``into`` (a new name), added in one pass without a shuffle. A null or empty
    text is scored on its statistics alone; a null length counts as the text's own."""
    at, long_at = docs.columns.index(text), docs.columns.index(n_chars)

    def run(parts):
        features = Features()
        for part in parts:
            lengths = part.column(long_at).to_pylist()
            told = [model.score(*features(t.as_py(), None if n is None else int(n))) for t, n in zip(part.column(at), lengths)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(told, pa.float64())], [*part.schema.names, into])

    if into in docs.columns:
        raise ValueError(f"docs has a column {into} already")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` per row of ``docs``."""
    model = fit_on(docs, labels, fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    scored = score(rows, model)
    return scored.select("doc_id", held_out, F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
