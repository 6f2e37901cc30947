"""Winnowing, norm-of-sum codes and phrase counting against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from ravelin.llm import boundquant, collocations, common, winnowing
from tests.llm.conftest import CLASHES, prose


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_leaks(docs, items, window):
    found = []
    cut = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))) for i, t in items]
    for doc_id, text in docs:
        words, hit, named = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)), set(), set()
        for item_id, own in cut:
            size = min(window, len(own))
            wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
            places = [i for i in range(len(words) - size + 1) if size and tuple(words[i : i + size]) in wanted]
            hit |= {i + j for i in places for j in range(size)}
            if places and item_id is not None:
                named.add(str(item_id))
        found.append((doc_id, len(words), len(hit), len(named), sorted(named), bool(hit)))
    return sorted(found, key=str)


@pytest.mark.parametrize("segment", [7, 1 << 16])
def test_leaks_equal_plain(spark, edge_rows, edge_docs, monkeypatch, segment):
    monkeypatch.setattr(winnowing, "SEGMENT", segment)
    monkeypatch.setattr(winnowing, "SLAB", 50)
    rng = random.Random(3)
    texts = [r[1] for r in edge_rows if r[1]]
    body, long = texts[0].split(), texts[5].split() if len(texts[5].split()) > 100 else max(texts, key=len).split()
    items = [(1, " ".join(body[5:30])), (2, " ".join(body[20:30])), (3, " ".join(body[21:30])), (4, "ONE, two!"), (5, None), (6, " . "), (7, " ".join(long[100:400])), (8, "a b a b a b a b a b"), (9, prose(rng, 30, 9_999))]
    items += [(2, " ".join(body[20:30])), (None, " ".join(body[40:52])), (10, " ".join(["w1"] * 200)), (11, "é ü 中文 🙂 1 b"), (12, "b")]
    frame = spark.createDataFrame([(i, t, "x", "x") for i, t in items], "item_id long, text string, row string, size string")
    got = winnowing.decontaminate(edge_docs, frame)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_leaks([(r[0], r[1]) for r in edge_rows], items, 10)


def test_leaks_of_random_texts(spark, monkeypatch):
    """Few words, so that windows repeat and share fingerprints; a full table of cells; no broadcast."""
    monkeypatch.setattr(winnowing, "CELL_BITS", (4, 4))
    monkeypatch.setattr(winnowing, "BROADCAST_WINDOWS", 0)
    for seed in range(3):
        rng = random.Random(seed)
        docs = [(i, prose(rng, rng.randrange(0, 300), 3)) for i in range(40)]
        items = [(i, prose(rng, rng.randrange(0, 14), 3)) for i in range(30)]
        got = winnowing.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 6)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_leaks(docs, items, 6)


def test_leaks_without_rows(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnowing.decontaminate(edge_docs, none).filter("contaminated OR n_items > 0").count() == 0
    assert winnowing.decontaminate(edge_docs, none).count() == edge_docs.count()
    assert winnowing.decontaminate(no_docs, none).count() == 0


def test_every_window_shares_its_fingerprint():
    """Two texts with a window in common choose the same fingerprint from it, whatever surrounds it."""
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 63, 10, np.uint64)
    for _ in range(50):
        one, two = (np.concatenate([rng.integers(0, 1 << 63, rng.integers(0, 20), np.uint64), shared, rng.integers(0, 1 << 63, 5, np.uint64)]) for _ in range(2))
        assert set(winnowing.chosen(one, 10)) & set(winnowing.chosen(two, 10))


def plain_codes(rows, entries, rounds):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    same = [r for r in kept if len(r[1]) == width]
    cuts = [i * width // 4 for i in range(5)]
    books = [[r[1][a:b] for r in same[:entries]] for a, b in zip(cuts, cuts[1:])]

    def nearest(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, c)), e) for e, c in enumerate(book))

    for r in range(rounds + 1):
        found = [[nearest(row[1][a:b], book) for a, b, book in zip(cuts, cuts[1:], books)] for row in same]
        if r < rounds:
            for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for e in range(len(books[part])):
                    mine = [row[1][a:b] for row, f in zip(same, found) if f[part][1] == e]
                    if mine:
                        books[part][e] = [sum(c) // len(mine) for c in zip(*mine)]
    totals = Counter()
    for row, f in zip(same, found):
        totals[row[2]] += sum(d for d, _ in f)
    fits = lambda x: x if x < 1 << 63 else None
    told = boundquant.hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    coded = {id(row): ("".join(f"{e:02x}" for _, e in f), fits(sum(d for d, _ in f))) for row, f in zip(same, found)}
    return sorted(((r[0], *coded.get(id(r), (None, None)), fits(totals[r[2]]) if r[2] in totals else None, told) for r in kept), key=str)


def coded(spark, rows, kind, entries, rounds=4):
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, of string")
    return sorted((tuple(r) for r in boundquant.compress_vectors(frame, entries, rounds).collect()), key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_codes_equal_plain(spark, kind):
    rng = random.Random(8)
    rows = [(i, [round(rng.gauss(i % 5, 0.4) * 4) / 4 for _ in range(10)], i % 3 if i % 7 else None) for i in range(150)]
    rows += [rows[3], rows[3], (3, rows[4][1], 1), (None, rows[5][1], 2), (900, None, 1), (901, [None] * 10, 1), (902, [float("nan")] * 10, 1), (903, [float("inf")] * 10, 1), (904, [1.0, 2.0], 1), (905, [], 9)]
    assert coded(spark, rows, kind, 40) == plain_codes(rows, 40, 4)


def test_codes_of_huge_components(spark):
    rows = [(i, [((-1) ** i) * 10.0 ** (i % 40), 0.5 * i, -3.0, 1e30], i % 2) for i in range(30)]
    assert coded(spark, rows, "double", 8) == plain_codes(rows, 8, 4)


def test_codes_of_few_and_none(spark):
    rows = [(1, [0.1, 0.2, 0.3, 0.4], None), (2, [1.0, -1.0, 5.0, 0.0], None)]
    assert coded(spark, rows, "float", 256) == plain_codes(rows, 256, 4)
    assert coded(spark, [], "float", 256) == [] == coded(spark, [(1, None, 1)], "float", 256)
    assert coded(spark, [(5, [], 1), (6, [], 1)], "float", 256) == plain_codes([(5, [], 1), (6, [], 1)], 256, 4)


def test_bounds_spare_distances_and_change_nothing(spark):
    """Codebooks and codes equal a full search in every round, with far fewer distances; net moves are never longer
    than the sum of the single ones."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 4, (64, 16))
    vectors = (centres[rng.integers(0, 64, 3_000)] + rng.normal(0, 0.3, (3_000, 16))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label string")
    out = boundquant.trained(spark, frame, 16, "<f4", 64, 6)
    x = boundquant.integers(vectors)
    for part in range(4):
        own, book = x[:, part * 4 : part * 4 + 4], x[:64, part * 4 : part * 4 + 4].copy()
        for r in range(7):
            assert np.array_equal(out.books[r][part], book), (r, part)
            entry = ((own[:, None] - book[None]) ** 2).sum(2).argmin(1)
            for e in np.unique(entry):
                book[e] = own[entry == e].sum(0) // (entry == e).sum()
    assert out.scanned[0] == 4 * 3_000 * 64 and out.scanned[-1] < out.scanned[0] / 4
    path = np.stack([b[0].astype(float) for b in out.books])
    assert (np.linalg.norm(path[-1] - path[0], axis=1) <= np.linalg.norm(np.diff(path, axis=0), axis=2).sum(0) + 1e-9).all()


def plain_phrases(rows, least, longest, percent, kept):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        inside = any(b >= least and len(q) > len(p) and q_lang == lang and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (q_lang, q), b in f.items() if len(q) > len(p))
        if not inside:
            score, _, left, right = min(cuts)
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    told = []
    for lang, phrase, *rest in out:
        ranks[lang] += 1
        if ranks[lang] <= kept:
            told.append((lang, ranks[lang], phrase, *rest))
    return told


def phrases(frame, *options, **more):
    return sorted(tuple(r) for r in collocations.collocations(frame, *options, **more).collect())


@pytest.mark.parametrize("bits,shards,longest", [((16, 26), 3, 3), ((3, 3), 2, 3), ((16, 26), 1, 2), ((6, 6), 4, 4)])
def test_phrases_equal_plain(spark, monkeypatch, bits, shards, longest):
    """Also with tables of cells so small that all phrases share them, and chunks of a few texts."""
    monkeypatch.setattr(collocations, "CELL_BITS", bits)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 900)
    monkeypatch.setattr(collocations, "MERGE_ROWS", 300)
    monkeypatch.setattr(collocations, "SALTS", 3)
    rng = random.Random(sum(bits) + shards)
    rows = []
    for i in range(90):
        words = [rng.choice(["A", "b", "new", "york", "City", "é", "x|y", f"w{rng.randrange(60)}", "."]) + rng.choice(["", "", "", ",", "\t", "\n"]) for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "fr", None, "l%d" % (i % 9)]), " ".join(words)))
    rows += [("en", None), ("en", ""), (None, " \t "), ("en", "new york city " * 40), ("xx", "a b"), rows[3], rows[3]]
    frame = spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], "lang string, text string, " + ", ".join(f"{c} string" for c in CLASHES))
    for least, kept in ((3, 2_000), (10, 5)):
        assert phrases(frame, least, longest, 50, kept, shards) == sorted(plain_phrases(rows, least, longest, 50, kept))


def test_rare_phrases_are_left_out_before_the_exchange():
    """A run comes back as it was, smaller than its text; of its phrases only those whose cell reached the threshold go
    on, each in one slice."""
    texts = [b"\n", b"", *(f"w{i}".encode() for i in range(300))]
    pairs = [np.array([i for i in range(2, 300) for _ in range(30)]), np.array([2 + (i * 7 + j) % 300 for i in range(2, 300) for j in range(30)])]
    found = [([np.arange(2, 302)], np.arange(1, 301)), (pairs, np.ones(len(pairs[0]), np.int64))]
    data = collocations.packed_run(found, texts)
    words, back = collocations.unpacked_run(data)
    for (columns, n), (old, n_old) in zip(back, found):
        assert [[words[i] for i in c] for c in columns] == [[texts[i] for i in c] for c in old] and n.tolist() == n_old.tolist()
    every = {b" ".join(texts[c[i]] for c in columns).decode(): int(n[i]) for columns, n in found for i in range(len(n))}
    assert len(data) * 4 < sum(map(len, every))
    hashes = np.frombuffer(collocations.word_hashes("en", words), np.uint64)
    often = collocations.cell(collocations.extended(hashes[back[1][0][0][:4]], hashes[back[1][0][1][:4]]), 16)
    progress = collocations.Progress(16)
    for _ in range(10):
        progress.add(np.bincount(often, minlength=2 << 16).astype(np.uint8), 1, 10)
    batch = pa.record_batch([pa.array(["en"]), pa.array([data], pa.binary())], names=["lang", "run"])

    def told(part, slices):
        out = collocations.summed_runs(collocations.packed(progress.since), 16, 3, part, slices)([batch])
        return [(x, n) for b in out for x, n in zip(b.column("phrase").to_pylist(), b.column("n").to_pylist())]

    want = [(texts[a] + b" " + texts[b]).decode() for a, b in zip(*(c[:4].tolist() for c in pairs))]
    assert set(want) <= set(dict(told(0, 1))) and len(told(0, 1)) < 40 and dict(told(0, 1)).items() <= every.items()
    assert sorted(x for k in range(5) for x in told(k, 5)) == sorted(told(0, 1))


@pytest.mark.parametrize("deal_rows,merge_rows", [(10**6, 10**6), (10**6, 500), (3_000, 8_000)])
def test_runs_meet_before_they_are_rows(monkeypatch, deal_rows, merge_rows):
    """Runs are joined and dealt to ranges without a loss, smaller than their text; where the runs of a range meet, each
    phrase that reaches the threshold is one row."""
    monkeypatch.setattr(collocations, "DEAL_ROWS", deal_rows)
    monkeypatch.setattr(collocations, "MERGE_ROWS", merge_rows)
    since, ranges, slices, got, size, want, runs = collocations.packed(np.ones(2 << 16, np.uint8)), 6, 2, {}, 0, Counter(), []
    rng = np.random.default_rng(3)
    for i in range(40):
        lang, texts = ("en", "und")[i % 2], [b"\n", b"", *(f"word{x}".encode() for x in rng.permutation(330)[:300])]
        places = [x.reshape(-1) for x in np.meshgrid(*[np.sort(rng.choice(np.arange(2, 302), 9, False))] * 3, indexing="ij")]
        pair = [x.reshape(-1) for x in np.meshgrid(np.arange(2, 302, 6), np.arange(2, 302, 6), indexing="ij")]
        found = [([np.arange(2, 302)], np.arange(1, 301)), (pair, np.arange(len(pair[0])) % 7 + 1), (places, np.ones(len(places[0]), np.int64))]
        for columns, n in found:
            for x, *at in zip(n.tolist(), *(c.tolist() for c in columns)):
                want[lang, b" ".join(texts[j] for j in at).decode()] += x
                size += sum(len(texts[j]) + 1 for j in at)
        runs.append((lang, collocations.packed_run(found, texts)))
    batch = pa.record_batch([pa.array([x for x, _ in runs]), pa.array([x for _, x in runs], pa.binary())], names=["lang", "run"])
    for part in range(slices):
        dealt = pa.Table.from_batches(collocations.dealt_runs(since, 16, 3, ranges, part, slices)([batch]))
        assert set(dealt["range"].to_pylist()) == set(range(part, ranges, slices))
        size -= 2 * sum(map(len, dealt["run"].to_pylist()))
        for k in range(part, ranges, slices):
            rows = collocations.whole_range(5, 3)(dealt.filter(pc.equal(dealt["range"], k)))
            told = dict(zip(zip(rows["lang"].to_pylist(), rows["phrase"].to_pylist()), rows["n"].to_pylist()))
            assert len(told) == len(rows) and not told.keys() & got.keys()
            got |= told
    assert got == {x: n for x, n in want.items() if n >= 5} and size > 0
    assert len(collocations.whole_range(10**9, 3)(dealt)) == 0


def test_each_task_sends_on_its_best_phrases_only():
    """They are the first ``kept`` per language by score, count and bytes of the phrase."""
    rng = random.Random(4)
    rows = [(rng.choice(["en", "fr", "und"]), f"{rng.choice(['é', 'z', 'a', '\U0001f600', '\uffee'])} {i}", rng.randrange(10, 13), 20, 20, rng.randrange(4)) for i in range(900)]
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), *((x, pa.int64()) for x in ("a", "l", "r", "score"))])
    batches = [pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 70]), schema)], schema=schema) for i in range(0, 900, 70)]
    got = [tuple(r.values()) for b in collocations.best_of_task(20)(iter(batches)) for r in b.to_pylist()]
    want = []
    for lang in ("en", "fr", "und"):
        want += sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[5], -r[2], r[1].encode()))[:20]
    assert sorted(got) == sorted(want)
    assert list(collocations.best_of_task(20)(iter([]))) == []


@pytest.mark.parametrize("share", [0, 1e-5, 0.004, 0.03, 0.2, 0.5, 1])
def test_parts_of_tables_come_back_and_follow_what_they_hold(share):
    rng = np.random.default_rng(5)
    for size in (1 << 18, 1_000):
        table = (rng.random(size) < share).astype(np.uint8) * rng.choice([1, 1, 1, 1, 2, 9, 255], size).astype(np.uint8)
        data = common.packed_part(table)
        assert (common.unpacked_part(data, size) == table).all()
        assert len(data) < 40 + 2 * np.count_nonzero(table)


def test_phrases_of_edge_rows_and_none(spark, edge_rows, edge_docs, no_docs):
    assert phrases(edge_docs, 3) == sorted(plain_phrases([(r[2], r[1]) for r in edge_rows], 3, 3, 50, 2_000))
    assert phrases(no_docs) == []


def test_score_is_exact_beyond_64_bits(spark, monkeypatch):
    """1000000 * a * a and l * r need more than 64 bits here."""
    a, left, right = 3_037_000_507, 3_037_000_511, 3_037_000_999
    rows = [("en", "p q", 2, a), ("en", "p", 1, left), ("en", "q", 1, right)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, size int, n long")
    sizes = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: (counts, sizes))
    assert phrases(counts) == [("en", 1, "p q", a, left, right, 10**13, 10**6 * a * a // (left * right))]
