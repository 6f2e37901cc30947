"""Insert-if-absent through the index of keys: same rows, and what a batch reads does not grow with the table."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ravelin.operators import keyindex, persist
from ravelin.operators.keyindex import KeyIndex


def rows(spark, low, high, step=1):
    ids = spark.range(low, high, step)
    return ids.select(F.concat(F.lit("e"), "id").alias("event_id"), F.timestamp_micros(F.col("id") * 3_600_000_000).alias("timestamp"), F.concat(F.lit("10.0.0."), F.col("id") % 40).alias("source_ip"), F.concat(F.lit("h"), F.col("id") % 30).alias("hostname"))


def stored(spark, path):
    return sorted(r["event_id"] or "" for r in spark.read.parquet(path).select("event_id").collect())


def test_batches_repeats_and_merges(spark, tmp_path):
    path, want = str(tmp_path / "t"), set()
    index = KeyIndex(spark, path, bucket_keys=50, most_runs=3)
    for low in (0, 60, 40, 40, 300, 250):
        index.insert(rows(spark, low, low + 100))
        want |= {f"e{i}" for i in range(low, low + 100)}
        assert stored(spark, path) == sorted(want)
    state = index.state()
    assert state.keys == len(want) and state.bits >= 1 and len(state.runs) <= 4
    index.insert(rows(spark, 0, 0))
    assert index.state() == state and len(list((tmp_path / "t_keys").glob("g*"))) == 1


def test_nulls_copies_and_the_first_by_time(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([(None, 5, "a", "h"), (None, 3, "b", "h"), ("", 4, "c", "h"), ("x", 9, "late", "h"), ("x", 2, "first", None)], "event_id string, at long, source_ip string, hostname string")
    batch = batch.select("event_id", F.timestamp_seconds("at").alias("timestamp"), "source_ip", "hostname")
    for _ in range(2):
        KeyIndex(spark, path).insert(batch)
    assert sorted(map(str, (tuple(r) for r in spark.read.parquet(path).select("event_id", "source_ip").collect()))) == sorted(map(str, [(None, "b"), ("", "c"), ("x", "first")]))


def test_a_table_from_before_is_indexed(spark, tmp_path):
    path = str(tmp_path / "t")
    persist.insert_if_absent(rows(spark, 0, 90), path)
    KeyIndex(spark, path, bucket_keys=16).insert(rows(spark, 80, 120))
    assert stored(spark, path) == sorted(f"e{i}" for i in range(120))


@pytest.mark.parametrize("broken", ["_write_run", "append_rows"])
def test_an_insert_that_broke_off_is_mended(spark, tmp_path, monkeypatch, broken):
    path = str(tmp_path / "t")
    KeyIndex(spark, path).insert(rows(spark, 0, 30))

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(KeyIndex if broken == "_write_run" else persist, broken, fail)
        with pytest.raises(RuntimeError):
            KeyIndex(spark, path).insert(rows(spark, 20, 60))
    for _ in range(2):
        KeyIndex(spark, path).insert(rows(spark, 20, 60))
    assert stored(spark, path) == sorted(f"e{i}" for i in range(60))


def test_what_a_batch_reads_does_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    read = []
    plain = KeyIndex._runs

    def counted(self, state, part, buckets):
        frame = plain(self, state, part, buckets)
        if frame is not None:
            read.append(sum(Path(f.removeprefix("file:")).stat().st_size for f in frame.inputFiles()))
        return frame

    monkeypatch.setattr(KeyIndex, "_runs", counted)
    path, costs = str(tmp_path / "t"), []
    index = KeyIndex(spark, path, bucket_keys=200, most_runs=1)
    for size in (4_000, 40_000):
        persist.append_rows(rows(spark, 0, size), path) if not costs else persist.append_rows(rows(spark, 4_000, size), path)
        index.build()
        read.clear()
        fresh = index.absent(rows(spark, size - 3, size + 3))
        assert fresh.count() == 3
        costs.append(sum(read))
    whole = sum(f.stat().st_size for f in (tmp_path / "t_keys").rglob("part=keys/**/*.parquet"))
    assert costs[1] <= 1.6 * costs[0] and costs[1] < whole / 10


def test_filters_miss_nothing():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3_000):
        held, others = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, 20_000, np.uint64)
        packed = keyindex.filter_of(held)
        assert keyindex.may_hold(packed, held).all() and keyindex.may_hold(packed, others).mean() < 0.03


def scanned_rows(frame):
    """Rows that came out of the scan: those of row groups no filter ruled out."""
    plan = frame._jdf.queryExecution().executedPlan()
    frame._jdf.collectAsList()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_a_source_or_host_reads_a_share_of_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    many = spark.range(20_000).select(F.col("id").cast("string").alias("event_id"), F.timestamp_micros(F.col("id") * 1_000_000).alias("timestamp"), F.concat(F.lit("10.0.0."), F.col("id") % 997).alias("source_ip"), F.concat(F.lit("h"), F.col("id") % 499).alias("hostname"))
    hot = spark.range(4_000).select(F.concat(F.lit("x"), "id").alias("event_id"), F.timestamp_micros(F.col("id") * 1_000_000).alias("timestamp"), F.lit("10.0.0.1").alias("source_ip"), F.lit("h1").alias("hostname"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        persist.append_rows(many.union(hot), path)
        table = spark.read.parquet(path)
        sizes = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) > 20 and max(sizes) < 2_000  # a pair of source and host that is busy is cut as well
        for found, want in ((persist.from_source(table, "10.0.0.77"), 20), (persist.on_host(table, "h77"), 40)):
            assert scanned_rows(found.select("event_id")) < 24_000 / 3 and found.count() in (want, want + 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_small_buckets_share_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    index = KeyIndex(spark, path, bucket_keys=4)
    index.insert(rows(spark, 0, 6_000))
    state = index.state()
    assert state.bits >= 10 and state.keys == 6_000
    assert len(list((tmp_path / "t_keys").rglob("*.parquet"))) <= 2 * 2**keyindex.FOLDER_BITS
    assert index.absent(rows(spark, 5_990, 6_010)).count() == 20 - 10


def test_an_index_of_the_layout_before_is_built_again(spark, tmp_path):
    path = str(tmp_path / "t")
    index = KeyIndex(spark, path)
    index.insert(rows(spark, 0, 30))
    told = index.state()
    index.files.write("state.json", '{"generation": "%s", "bits": 0, "keys": 30, "runs": ["run=gone"]}' % told.generation)
    index.insert(rows(spark, 20, 60))
    assert stored(spark, path) == sorted(f"e{i}" for i in range(60)) and index.state().keys == 60
