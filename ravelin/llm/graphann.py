"""Approximate nearest neighbours by cosine on robust-pruned directed graphs, one per shard.

Equal vectors are one node. A shard's graph starts random; in two passes a greedy search from the node nearest the
centre proposes neighbours for each node, and relaxed pruning keeps a candidate only if no kept one is nearer to it by
the factor ALPHA, so edges stay diverse. Reverse edges are added and pruned alike. Queries run a beam search in every
shard; what it finds is scored exactly, and the best of all shards are ranked. Work inside a shard runs on arrays, for
many nodes or queries at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import materialise

SHARD_ROWS = 4_096  # nodes of a graph on average
QUERY_ROWS = 4_096  # queries of a block on average
DEGREE = 24
BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
BATCH = 512
EXPAND = 4
SEED = 11


def tamed(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component near one: cosines stay the same to the
    last bit, and squares cannot overflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = tamed(vectors)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the nodes found, nearest first, and their squared distances; -1 and infinity fill short rows."""
    n = len(queries)
    rows = np.arange(n)[:, None]
    ids = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(points)), bool)
    ids[:, 0], open_[:, 0] = entry, True
    far[:, 0] = 2 - 2 * (queries @ points[entry])
    seen[:, entry] = True
    live = np.arange(n)
    while len(live):
        best = np.argsort(np.where(open_[live], far[live], np.inf), 1)[:, :EXPAND]
        at = live[:, None]
        going = open_[at, best]
        open_[at, best] = False
        near = graph[np.where(going, ids[at, best], 0)]
        near[~going] = -1
        near = np.sort(near.reshape(len(live), -1), 1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[at, near]
        seen[np.broadcast_to(at, near.shape)[fresh], near[fresh]] = True
        # only what is new is measured
        r, c = np.nonzero(fresh)
        distance = np.full(near.shape, np.inf, np.float32)
        distance[r, c] = 2 - 2 * np.einsum("ij,ij->i", points[near[r, c]], queries[live[r]])
        all_far = np.concatenate((far[live], distance), 1)
        keep = np.argsort(all_far, 1, kind="stable")[:, :beam]
        side = np.arange(len(live))[:, None]
        far[live] = all_far[side, keep]
        ids[live] = np.concatenate((ids[live], near), 1)[side, keep]
        open_[live] = np.concatenate((open_[live], fresh), 1)[side, keep]
        ids[live] = np.where(np.isinf(far[live]), -1, ids[live])
        live = live[open_[live].any(1)]
    return ids, far


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """At most ``degree`` of each node's candidates (-1 fills), the nearest first, leaving out those that a kept one
    is nearer to."""
    near = np.sort(candidates, 1)
    valid = (near >= 0) & (near != nodes[:, None])
    valid[:, 1:] &= near[:, 1:] != near[:, :-1]
    vectors = points[near]
    far = np.where(valid, 2 - 2 * np.einsum("bmd,bd->bm", vectors, points[nodes]), np.inf)
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    for k in range(degree):
        pick = np.argmin(far, 1)
        found = np.isfinite(far[rows, pick])
        if not found.any():
            break
        out[found, k] = near[rows, pick][found]
        between = 2 - 2 * np.einsum("bmd,bd->bm", vectors, vectors[rows, pick])
        far[alpha * between <= far] = np.inf
        far[rows, pick] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> tuple[np.ndarray, int]:
    """Neighbours of every node (-1 fills) and the entry node."""
    n = len(points)
    rng = np.random.default_rng(SEED)
    entry = int(np.argmax(points @ points.mean(0)))
    graph = rng.integers(0, n, (n, degree)).astype(np.int32)
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            nodes = order[at : at + BATCH]
            found, _ = beam_search(points, graph, entry, points[nodes], beam)
            graph[nodes] = robust_prune(points, nodes, np.concatenate((found, graph[nodes]), 1), alpha, degree)
            _add_reverse(points, graph, nodes, alpha)
    return graph, entry


def _add_reverse(points: np.ndarray, graph: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    degree = graph.shape[1]
    to = graph[nodes].reshape(-1).astype(np.int64)
    source = np.repeat(nodes, degree)[to >= 0]
    to = to[to >= 0]
    if not len(to):  # a single node
        return
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    targets, starts, counts = np.unique(to, return_index=True, return_counts=True)
    by_size = np.argsort(counts, kind="stable")
    for part in np.array_split(by_size, max(1, len(by_size) // 256)):
        width = int(counts[part].max())
        places = starts[part][:, None] + np.arange(width)
        new = np.where(np.arange(width) < counts[part][:, None], source[np.minimum(places, len(source) - 1)], -1)
        graph[targets[part]] = robust_prune(points, targets[part], np.concatenate((graph[targets[part]], new), 1), alpha, degree)


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) without repeats; vectors that are null, empty, zero, or hold null or non-finite components, and
    rows without an id, take no part."""
    vector = F.col(vector_col).cast("array<double>")
    out = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).filter("id IS NOT NULL AND size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return out.filter(finite & F.exists("vector", lambda x: x != 0)).distinct()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return np.asarray(values.flatten()).reshape(len(values), -1)


_INDEX = "shard long, node int, entry int, ids array<long>, vector array<double>, neighbours array<int>"
_INDEX_ARROW = pa.schema([("shard", pa.int64()), ("node", pa.int32()), ("entry", pa.int32()), ("ids", pa.list_(pa.int64())), ("vector", pa.list_(pa.float64())), ("neighbours", pa.list_(pa.int32()))])


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The graphs of all shards as a checkpointed table, and the number of shards per vector length. A node keeps its
    k + 1 smallest ids: with ties going to smaller ids, no other can be among the k nearest of any query."""
    least = Window.partitionBy("vector").orderBy("id")
    nodes = vectors.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= k + 1)
    nodes = materialise(nodes.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", F.size("vector").cast("long") * shards + F.pmod(F.xxhash64("vector"), F.lit(shards)))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")])
        points = unit(_matrix(table["vector"])).astype(np.float32)
        graph, entry = build_graph(points)
        n = table.num_rows
        return pa.table([table["shard"], pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, entry, np.int32)), table["ids"], table["vector"], pa.array(list(graph), pa.list_(pa.int32()))], schema=_INDEX_ARROW)

    dealt = dealt.withColumn("first", F.element_at("ids", 1))
    return materialise(dealt.groupBy("shard").applyInArrow(build, _INDEX)), shards


def search(index: DataFrame, shards: int, queries: DataFrame, k: int, query_rows: int = QUERY_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, vec_id, score): at most k per query and shard. Queries come in blocks, and each block meets each
    shard of its vector length in one task, so a task holds one graph and one block."""
    blocks = max(1, -(-queries.count() // query_rows))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("part")
    asked = queries.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), every)
    asked = asked.select("id", "vector", "block", (F.size("vector").cast("long") * shards + F.col("part")).alias("shard"))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(graphs: pa.Table, block: pa.Table) -> pa.Table:
        if not graphs.num_rows or not block.num_rows:
            return schema.empty_table()
        graphs = graphs.sort_by([("node", "ascending")])
        exact, asked_exact = tamed(_matrix(graphs["vector"])), tamed(_matrix(block["vector"]))
        norms, asked_norms = (np.sqrt(np.square(m).sum(1)) for m in (exact, asked_exact))
        points, wanted = unit(exact).astype(np.float32), unit(asked_exact).astype(np.float32)
        neighbours, ids, query_ids = _matrix(graphs["neighbours"]), graphs["ids"].to_pylist(), block["id"].to_pylist()
        out = []
        for at in range(0, len(wanted), BATCH):
            found, _ = beam_search(points, neighbours, graphs["entry"][0].as_py(), wanted[at : at + BATCH], max(beam, 2 * k))
            for q, nodes in enumerate(found, at):
                nodes = nodes[nodes >= 0]
                scores = (exact[nodes] * asked_exact[q]).sum(1) / (norms[nodes] * asked_norms[q])
                best = sorted((-s, v) for s, n in zip(scores.tolist(), nodes.tolist()) for v in ids[n] if v != query_ids[q])[:k]
                out += [(query_ids[q], v, -s) for s, v in best]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    return held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest rows found of each query but itself: ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the
    cosine; ties go to smaller ids. A query id with several vectors asks with the least one; a row id with several is
    found by its nearest."""
    index, shards = build_index(clean_vectors(rows, id_col, vector_col), k, shard_rows)
    asked = clean_vectors(queries, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector"))
    found = search(index, shards, asked, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
