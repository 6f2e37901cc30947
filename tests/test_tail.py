"""Growing files as a stream: each whole line once, over triggers, restarts and rotation."""

import os
import random

import pytest

from ravelin.operators.logs import parse_log_lines
from ravelin.sources import tail


class Run:
    """A query on the growing files; it can be started again on its checkpoint."""

    def __init__(self, spark, folder, name, **options):
        self.spark, self.folder, self.name, self.options = spark, folder, name, options
        self.start()

    def start(self):
        out, where = str(self.folder / f"out-{self.name}"), str(self.folder / f"cp-{self.name}")
        stream = tail.tail_growing_files(self.spark, str(self.folder / "logs"), **self.options)
        self.query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", where).trigger(processingTime="0 seconds").start()
        return self

    def stop(self):
        self.query.processAllAvailable()
        self.query.stop()

    def lines(self, finish=True):
        if finish:
            self.query.processAllAvailable()
        rows = self.spark.read.parquet(str(self.folder / f"out-{self.name}")).collect()
        return sorted((os.path.basename(r["path"]), r["line"]) for r in rows)


@pytest.fixture
def logs(tmp_path):
    (tmp_path / "logs").mkdir()
    return tmp_path


def add(folder, name, text):
    with open(folder / "logs" / name, "a") as file:
        file.write(text)


def test_appended_lines_come_once_also_over_a_restart(spark, logs):
    add(logs, "a.log", "one\n\ntwo\nhal")
    run = Run(spark, logs, "append")
    assert run.lines() == [("a.log", "one"), ("a.log", "two")]
    add(logs, "a.log", "f line\nthree\n")
    add(logs, "b.log", "x\r\n")
    assert run.lines() == [("a.log", "half line"), ("a.log", "one"), ("a.log", "three"), ("a.log", "two"), ("b.log", "x")]
    run.stop()
    add(logs, "a.log", "four\n")
    run.start()
    assert run.lines()[1] == ("a.log", "half line") and len(run.lines()) == 6 and ("a.log", "four") in run.lines()
    os.rename(logs / "logs" / "a.log", logs / "logs" / "a.log.1")  # rotated: the moved file is not read again
    add(logs, "a.log", "new first\n")
    add(logs, "a.log.1", "last words\n")
    assert len(run.lines()) == 8 and {("a.log", "new first"), ("a.log.1", "last words")} <= set(run.lines())
    run.stop()


def test_small_triggers_and_ranges(spark, logs):
    rng = random.Random(4)
    want = []
    for name in ("a.log", "b.log"):
        lines = ["".join(rng.choice("xyzé ") for _ in range(rng.randrange(0, 90))) + str(i) for i in range(150)] + ["w" * 3_000]
        add(logs, name, "".join(f"{line}\n" for line in lines))
        want += [(name, line) for line in lines]
    run = Run(spark, logs, "ranges", maxBytes=4_000, rangeBytes=700, checkpoint=str(logs / "cp-ranges"))
    assert run.lines() == sorted(want)
    run.stop()
    assert len(os.listdir(logs / "cp-ranges" / "commits")) > 4
    add(logs, "b.log", "".join(f"more {i}\n" for i in range(1_000)))
    run.start()  # goes on in small steps
    assert run.lines() == sorted(want + [("b.log", f"more {i}") for i in range(1_000)])
    run.stop()
    assert len(os.listdir(logs / "cp-ranges" / "commits")) > 7


def test_a_cut_file_is_read_from_its_start(spark, logs):
    add(logs, "a.log", "first content here\nmore\n")
    run = Run(spark, logs, "cut")
    run.lines()
    (logs / "logs" / "a.log").write_text("other\n")
    assert run.lines() == [("a.log", "first content here"), ("a.log", "more"), ("a.log", "other")]
    run.stop()


def test_start_at_the_end_and_events(spark, logs):
    add(logs, "a.log", "old\n")
    stream = tail.tail_growing_files(spark, str(logs / "logs" / "*.log"), startAt="end")
    events = parse_log_lines(stream, offset="offset")
    query = events.select("event_id", "type", "raw_message").writeStream.format("memory").queryName("tail_end").option("checkpointLocation", str(logs / "cp")).start()
    query.processAllAvailable()
    add(logs, "a.log", "Jan 01 00:00:00 h sshd[1]: Failed password for x from 1.2.3.4 port 1\n" * 2)
    query.processAllAvailable()
    rows = spark.table("tail_end").collect()
    assert len(rows) == 2 == len({r["event_id"] for r in rows}) and {r["type"] for r in rows} == {"EVENT_TYPE_AUTH_FAILURE"}
    query.stop()
