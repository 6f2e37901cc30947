"""Revisits, graph search, classifier, BPE, packing and id blocks against plain versions."""

import json
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ravelin.llm import bestfit, bpecodec, fmquality, graphann, rangecoder, revisits
from ravelin.llm.common import fresh_path, table

RECORD = "record_id long, url string, kind string, fetched_at long, etag string, last_modified string, headers map<string,string>, payload string"


def resolve(spark, rows):
    return {r["record_id"]: r for r in revisits.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}


def test_revisit_cases(spark):
    site = "https://A.example.org:443/x?b=2&utm_source=q&a=1#top"
    rows = [
        (1, site, "response", 10, '"one"', "d1", {"etag": '"one"', "content-type": "text/html", "date": "10"}, "p1"),
        (2, "http://a.example.org/x?a=1&b=2", "response", 20, 'W/"two"', None, {"etag": 'W/"two"', "content-length": "5"}, "p2"),
        (3, site, "revisit", 15, '"one"', None, {"date": "15", "content-length": "0", "set-cookie": "x"}, None),
        (4, site, "revisit", 20, '"one"', None, {}, None),  # a response of the same time is not earlier
        (5, site, "revisit", 25, '"two"', None, None, None),  # weak comparison, latest response
        (6, site, "revisit", 25, '"one"', None, None, None),
        (7, site, "revisit", 25, None, "d1", None, None),
        (8, site, "revisit", 5, '"one"', None, None, None),
        (9, None, "revisit", 30, '"one"', None, None, None),
        (10, site, "revisit", None, '"one"', None, None, None),
        (11, site, "request", 1, None, None, None, None),
        (12, "mailto:x", "revisit", 9, None, None, None, None),
    ]
    got = resolve(spark, rows)
    assert {k: (r["outcome"], r["response_id"], r["payload"]) for k, r in got.items()} == {
        3: ("resolved", 1, "p1"), 4: ("resolved", 1, "p1"), 5: ("resolved", 2, "p2"), 6: ("mismatch", 2, None), 7: ("unverified", 2, None),
        8: ("orphan", None, None), 9: ("orphan", None, None), 10: ("orphan", None, None), 12: ("orphan", None, None),
    }
    assert got[3]["canonical_url"] == "a.example.org/x?a=1&b=2" and got[12]["canonical_url"] == "mailto:x"
    assert got[3]["headers"] == {"etag": '"one"', "content-type": "text/html", "date": "15"}
    assert got[5]["headers"] == {"etag": 'W/"two"', "content-length": "5"}


def test_revisits_of_a_busy_url(spark):
    """Most records are of one URL and lie in several ranges; ties in time and repeated rows are among them."""
    rng = random.Random(1)
    rows = []
    for i in range(600):
        url = "http://busy/" if rng.random() < 0.8 else f"http://h{rng.randrange(9)}/"
        kind = rng.choice(["response", "revisit", "revisit"])
        rows.append((i, url, kind, rng.randrange(200), rng.choice(['"a"', '"b"', None]), None, None, f"p{i}"))
    rows += rows[:30]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = revisits.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = Counter()
    for r in rows:
        if r[2] == "revisit":
            full = max(((x[3], x[0]) for x in rows if x[2] == "response" and x[1] == r[1] and x[3] < r[3]), default=(None, None))
            want[r[0], full[1]] += 1
    assert Counter((r["record_id"], r["response_id"]) for r in found) == want
    assert resolve(spark, []) == {}


@pytest.mark.parametrize("partitions", ["2", "7"])
def test_revisits_at_fractional_times(spark, partitions):
    """A response half a unit earlier answers, on both sides of a range's border."""
    rows = [(i, "http://busy/", "response" if i % 2 else "revisit", 10 + i / 4 - i % 3, '"a"', None, None, f"p{i}") for i in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = revisits.resolve_revisits(spark.createDataFrame(rows, RECORD.replace("fetched_at long", "fetched_at double"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    want = {r[0]: max(((x[3], x[0]) for x in rows if x[2] == "response" and x[3] < r[3]), default=(None, None))[1] for r in rows if r[2] == "revisit"}
    assert {r["record_id"]: r["response_id"] for r in found} == want


def plain_nearest(rows, queries, k):
    def good(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    points = {i: np.array(v, float) / max(map(abs, v)) for i, v in rows if good(v)}
    out = {}
    for q in queries:
        if q in points:
            a = points[q]
            scored = sorted((-float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)), i) for i, b in points.items() if i != q and len(b) == len(a))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def as_lists(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_nearest_of_edges(spark):
    """Copies, ties, other lengths, and vectors that take no part."""
    rows = [(i, [1.0, 0.0]) for i in range(0, 40, 2)] + [(1, [0.0, 2.0]), (3, [0.0, 0.5]), (5, None), (7, []), (9, [0.0, 0.0]), (11, [None, 1.0]), (13, [float("nan"), 1.0]), (15, [float("inf"), 1.0]), (17, [1.0, 1.0, 1.0]), (19, [3e200, 3e200])]
    docs = spark.createDataFrame([(*r, "x", "x") for r in [*rows, rows[0]]], "vec_id long, embedding array<double>, score string, shard string")
    got = as_lists(graphann.nearest(docs, docs.filter("vec_id % 3 = 0 OR vec_id IN (17, 19)"), 5, shard_rows=8))
    want = plain_nearest(rows, [0, 3, 6, 12, 18, 24, 30, 36, 17, 19], 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    assert got[0] == [(2, 1.0), (4, 1.0), (6, 1.0), (8, 1.0), (10, 1.0)] and 17 not in got
    assert graphann.nearest(docs.limit(0), docs.limit(0)).count() == 0


def test_recall(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    queries = vectors.filter("vec_id % 50 = 0")
    got = as_lists(graphann.nearest(vectors, queries, 5, shard_rows=1500))
    want = plain_nearest([tuple(r) for r in vectors.select("vec_id", "embedding").collect()], [r[0] for r in queries.select("vec_id").collect()], 5)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found / sum(map(len, want.values())) >= 0.9
    scores = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(abs(scores.get((q, i), s) - s) < 1e-12 for q, v in got.items() for i, s in v)


def test_pruned_edges_are_diverse():
    rng = np.random.default_rng(1)
    points = graphann.unit(rng.normal(size=(300, 8))).astype(np.float32)
    graph, _ = graphann.build_graph(points, degree=10)
    for node in range(0, 300, 29):
        edges = [int(x) for x in graph[node] if x >= 0]
        assert len(set(edges)) == len(edges) and node not in edges


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = fmquality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in rows)
    clean = [r["predicted"] for r in rows if r["quality"] == 1]
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95 and np.mean(clean) > 0.97


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    size = fmquality.BUCKETS + fmquality.N_STATS
    model = fmquality.Model(0.3, rng.normal(size=size), rng.normal(size=(size, 8)), np.zeros(fmquality.N_STATS), np.ones(fmquality.N_STATS))
    buckets, values = np.array([3, 9, 70], np.int32), rng.normal(size=fmquality.N_STATS)
    x = dict(zip([*buckets.tolist(), *range(fmquality.BUCKETS, size)], [*[1 / np.sqrt(3)] * 3, *model.stats(values).tolist()]))
    pairs = sum(model.factors[i] @ model.factors[j] * x[i] * x[j] for i in x for j in x if i < j)
    y = 0.3 + sum(model.linear[i] * v for i, v in x.items()) + pairs
    assert model.score(buckets, values) == pytest.approx(1 / (1 + np.exp(-y)))


def test_classifier_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(2, 1, 0), (None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    rows = fmquality.quality_scores(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0.5 for r in fmquality.quality_scores(edge_docs, labels.limit(0)).collect())
    assert fmquality.quality_scores(no_docs, labels).count() == 0


def fuzz(seed, n):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'LL", "'ll", "1", "²", "é", "ñ", "<|endoftext|>", "<|", "中", "!", "...", " ", "　", "\x85", "\x1c", "the", "ing", "🙂", "_"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(n)] + ["a" * 3000, "-" * 2000, " *777+x", "\n" * 50 + " y", "ab" * 999, ""]


def test_encoder_equals_the_library(packed, tokenizer):
    codec, texts = bpecodec.BytePairCodec(packed), fuzz(1, 6000)
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        got = codec.encode(text)
        assert got == want.ids, text
        assert codec.decode(got) == tokenizer.decode(got, skip_special_tokens=False) == text
    for piece in ["thereabouts", "antidisestablishmentarianism", "ééé", "zzzzzz"]:
        assert codec.encode_piece(piece.encode()) == codec.merged(piece.encode())
    for ids in ([220, 128, 50256], [157, 98], []):
        assert codec.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_pairs_by_their_edges(packed):
    """Walking the merge trees' edges says what merging the joint bytes says, also for halves of longer tokens."""
    codec, rng = bpecodec.BytePairCodec(packed), random.Random(2)
    normal = sorted({i for i, t in enumerate(codec.tokens) if t} - set(codec.special.values()))
    number = {codec.tokens[i]: i for i in normal}
    pairs = [(rng.choice(normal), rng.choice(normal)) for _ in range(3_000)] + [(i, i) for i in normal[:500]]
    for i in rng.sample(normal, 3_000):
        text = codec.tokens[i]
        pairs += [(number[text[:k]], number[text[k:]]) for k in range(1, len(text)) if text[:k] in number and text[k:] in number]
    plain = {(a, b): codec.merged(codec.tokens[a] + codec.tokens[b]) == [a, b] for a, b in pairs}
    assert codec.timely and {p: codec.apart(*p) for p in plain} == plain and len(set(plain.values())) == 2


def test_generations_of_words_change_nothing(packed, monkeypatch):
    monkeypatch.setattr(bpecodec, "CHUNKS_KEPT", 8)
    small, texts = bpecodec.BytePairCodec(packed), fuzz(3, 400)
    monkeypatch.undo()
    large = bpecodec.BytePairCodec(packed)
    monkeypatch.setattr(bpecodec, "CHUNKS_KEPT", 8)
    got = [small.encode(t) for t in texts]
    monkeypatch.undo()
    assert got == [large.encode(t) for t in texts]


def test_codec_of_edges(edge_docs, edge_rows, packed, no_docs):
    got = Counter(tuple(r) for r in bpecodec.decode(bpecodec.encode(edge_docs, packed), packed).collect())
    assert got == Counter((i, t or "") for i, t, *_ in edge_rows)
    assert bpecodec.round_trip(edge_docs, packed).filter("n_tokens = 0").count() == sum(not t for _, t, *_ in edge_rows)
    assert bpecodec.round_trip(no_docs, packed).count() == 0


def plain_pack(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and (source is None or source not in b["sources"]) and (cluster is None or cluster not in b["clusters"])]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        bins[i]["left"] -= size
        bins[i]["sources"].add(source)
        bins[i]["clusters"].add(cluster)
        out.append(i)
    return out


def test_packing_is_the_tightest_compatible_fit():
    rng = random.Random(3)
    for _ in range(60):
        items = sorted(((rng.randrange(1, 60), rng.choice(["a", "b", "c", None]), rng.choice([1, 2, None, rng.random()])) for _ in range(rng.randrange(60))), key=lambda x: -x[0])
        bins, offsets = bestfit.pack([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], 60)
        assert bins == plain_pack(items, 60)
        used = Counter()
        for (size, *_), b, o in zip(items, bins, offsets):
            assert o == used[b]
            used[b] += size


def test_packing_of_edges(edge_docs, edge_rows, no_docs):
    rows = bestfit.pack_documents(edge_docs, capacity=64, shard_items=5).collect()
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += r["n_words"]
    want = Counter()
    for i, t, *_ in edge_rows:
        want[i] += len((t or "").encode().split())
    assert words == want and {r["doc_id"] for r in rows} == {r[0] for r in edge_rows}
    placed = [r for r in rows if r["bin_id"] is not None]
    fill = Counter()
    for r in placed:
        fill[r["bin_id"]] += r["n_words"]
    assert max(fill.values()) <= 64 and all((r["bin_id"] is None) == (r["n_words"] == 0) for r in rows)
    assert len({(r["bin_id"], r["bin_offset"]) for r in placed}) == len(placed)
    source = {i: s for i, _, _, s, _ in edge_rows}
    assert max(Counter((r["bin_id"], source[r["doc_id"]]) for r in placed if r["doc_id"] is not None and source[r["doc_id"]]).values()) == 1
    assert bestfit.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("n,size,top", [(0, 9, 9), (1, 9, 9), (40, 3, 3), (5_000, 50_257, 50_257), (30_000, 500, 40), (9_000, 70_000, 70_000)])
def test_blocks_round_trip(n, size, top):
    ids = (np.random.default_rng(n).zipf(1.3, n) % top).astype(np.uint32)
    blocks = rangecoder.encode_stream(ids, size, 1_000)
    assert (rangecoder.decode_stream(blocks) == ids).all() and len(blocks) == -(-n // 1_000)
    for i in range(min(3, len(blocks))):  # every block stands by itself
        assert (rangecoder.decode_stream([blocks[i]]) == ids[i * 1_000 : (i + 1) * 1_000]).all()


def test_blocks_compress_and_show_damage():
    ids = np.tile(np.random.default_rng(1).integers(0, 50_257, 50), 40)
    (block,) = rangecoder.encode_stream(ids, 50_257)
    assert len(block) * 8 < 4 * len(ids)
    for at in (0, 9, 14, len(block) // 2):
        broken = bytearray(block)
        broken[at] ^= 0x55
        with pytest.raises((ValueError, IndexError)):
            rangecoder.decode_stream([bytes(broken)])


def test_id_files(spark, edge_docs, edge_rows, packed, tokenizer, no_docs):
    path = fresh_path(spark, "ids")
    rangecoder.write_ids(edge_docs, packed, path, part_bytes=2_000)
    rows = rangecoder.read_ids(spark, path).orderBy("start").collect()
    ordered = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for got, (doc_id, text, *_) in zip(rows, ordered, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got["doc_id"], got["start"], got["n_tokens"], got["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(got["ids"]) == ids.tobytes()
        start += len(ids)
    rangecoder.write_ids(no_docs, packed, empty := fresh_path(spark, "ids"))
    assert rangecoder.read_ids(spark, empty).count() == 0


def test_cached_tokenizer_equals_the_library(packed, tokenizer):
    texts = fuzz(2, 3000)
    assert rangecoder.CachedTokenizer(packed)(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_the_state_of_a_block_does_not_grow_with_the_vocabulary():
    ids = (np.random.default_rng(7).zipf(1.2, 64 * 300) % 50_257).astype(np.uint32)
    tracemalloc.start()
    try:
        blocks = rangecoder.encode_stream(ids, 50_257, 64)
        assert (rangecoder.decode_stream(blocks) == ids).all()
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
    part = -(-rangecoder.PART_BYTES // 2 // rangecoder.BLOCK_IDS)  # blocks of a part with an id for every two bytes
    assert len(rangecoder.groups(part)) == 1


def test_a_block_does_not_depend_on_those_beside_it():
    ids = (np.random.default_rng(8).zipf(1.2, 7_003) % 5_000).astype(np.uint32)
    blocks = rangecoder.encode_stream(ids, 5_000, 1_500)
    assert blocks == [b for a in range(0, len(ids), 1_500) for b in rangecoder.encode_stream(ids[a : a + 1_500], 5_000)]
    mixed = [*blocks, *rangecoder.encode_stream(ids[:43], 5_000)]
    assert (rangecoder.decode_stream(mixed) == np.concatenate([ids, ids[:43]])).all()


def test_ids_by_rank_equal_the_library(packed, tokenizer):
    texts = [*fuzz(5, 400), "", " ", "a", " a  b \n c\u2003d ", "x" * 3_000 + " y", "\U0001f642 \u1e9e <|endoftext|> z<|endoftext|>z", "\x1c a \x1cb", "caf\u00e9 \u4e2d\u6587 \u0e01\u0e33 1\u00bd"]
    want = [[*e.ids, 0] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    tokens = rangecoder.CachedTokenizer(packed)
    assert tokens.fast
    spec = json.loads(zlib.decompress(packed))
    spec["model"]["merges"][300:302] = spec["model"]["merges"][301:299:-1]
    spec["model"]["merges"][40_000], spec["model"]["merges"][5] = spec["model"]["merges"][5], spec["model"]["merges"][40_000]
    other = zlib.compress(json.dumps(spec).encode())
    slow = rangecoder.CachedTokenizer(other)
    assert not slow.fast  # some tokens are not what their letters merge to
    for coder, expected in ((tokens, want), (slow, [[*e.ids, 0] for e in slow.inner.encode_batch(texts, add_special_tokens=False)])):
        ids, sizes = coder.encode(pa.array(texts), [0])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == expected


def test_columns_of_length_follow_the_text(spark):
    from ravelin.llm.stages import with_length

    docs = spark.createDataFrame([(1, "abc", 9), (2, "é", None), (3, None, 4)], "doc_id long, text string, n_chars long")
    assert [r["n_chars"] for r in with_length(docs).orderBy("doc_id").collect()] == [3, None, 0]
