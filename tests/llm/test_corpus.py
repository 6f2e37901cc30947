"""Registered queries against SQL, and the pipeline against a plain one."""

import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import rows_of
from ravelin.llm import bestfit, fmquality, secretscan, stages
from ravelin.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def test_registered():
    names = contract.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, database, name):
    frame = QUERIES[name](spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = database.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == rows_of(columns, result.fetchall())


def test_near_duplicate_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r["doc_id"]: tuple(r) for r in QUERIES["op6_signature_join"](spark, sf_dir).collect()} == brute.near_groups(rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op6_signature_join"}))
def test_query_is_whole(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    if name.startswith("op3"):
        assert frame.groupBy("query_id").count().filter("count <> 5").count() == 0
    else:
        assert frame.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """The classifier is fitted by the operator; what follows from its scores is done in plain Python."""
    rng = random.Random(6)
    passage = prose(rng, 30, 3_000)
    rows = []
    for i in range(120):
        if i % 6 == 5:
            text = " ".join(f"w{rng.randrange(99)}###" for _ in range(80))
        elif i % 10 == 3 and i > 20:
            words = rows[i - 17][1].split(" ")
            edits = 1 + (i // 10) % 3  # similarities from 0.95 down to about 0.8
            for j in range(edits):
                words[(j + 1) * len(words) // (edits + 1)] = "edit"
            text = " ".join(words)
        else:
            text = f"{prose(rng, rng.randrange(60, 90), 3_000)} {passage if i % 4 == 0 else ''} {'token=abcdef123' if i % 7 == 0 else ''} {prose(rng, 40, 3_000)}"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    folder = str(tmp_path)
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int("###" not in r[1]), 0) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")

    good = {r["doc_id"] for r in fmquality.quality_scores(docs, labels).collect() if r["predicted"]}
    assert good == {i for i, r in enumerate(rows) if "###" not in r[1]}
    left = [r[:2] for r in rows if r[0] in good]
    groups = brute.near_groups(left, stages.NEAR_PERCENT)
    left = [r for r in left if groups[r[0]][3]]
    assert len(left) < len(good)
    texts = []
    for (doc_id, n, gone, _, kept), (_, text) in zip(brute.substrings(left, 20), left):
        if gone < n or not n:
            texts.append((doc_id, kept if gone else text))
    machine = secretscan.Automaton.compile()
    texts = [(i, secretscan.masked(t.encode(), machine.spans(t.encode()), machine.rules).decode()) for i, t in texts]
    assert any("[assign]" in t for _, t in texts)
    want = spark.createDataFrame([(i, t, f"src{i % 3}") for i, t in texts], "doc_id long, text string, source string")
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, bestfit.pack_documents(want).collect()))


def test_near_duplicate_stage_links_from_80_percent(spark):
    """Pairs between 0.80 and 0.85 go, as ends of a group and as its bridges; pairs below 0.80 stay."""
    rng = random.Random(13)
    rows = []

    def add(words):
        rows.append((len(rows), " ".join(words)))
        return words

    for _ in range(20):
        base = prose(rng, 104, 10**6).split()
        add(base)
        one = add([*base[:94], *prose(rng, 10, 10**6).split()])  # 90 of 110 shingles
        add([*prose(rng, 10, 10**6).split(), *one[10:]])  # linked to the one before only
        add([*base[:88], *prose(rng, 16, 10**6).split()])  # 84 of 116 shingles of the first
    wide, narrow = brute.near_groups(rows, 80), brute.near_groups(rows, 85)
    assert sum(r[3] for r in wide.values()) < sum(r[3] for r in narrow.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = stages.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i, r in sorted(wide.items()) if r[3]]


def test_stages_keep_the_columns(spark, edge_docs, tmp_path):
    """Nulls, copies and columns with clashing names go through all stages."""
    folder = str(tmp_path)
    edge_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, folder)
        rows = out.collect()
        assert rows, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
    assert set(corpus_pipeline.STAGES[0][1](spark, edge_docs, folder).columns) == set(edge_docs.columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge_docs.limit(0), folder).count() == 0
