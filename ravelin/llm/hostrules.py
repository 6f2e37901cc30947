"""Quality rules with a verdict per host.

Every document is measured (words, symbols, repeated lines, repeated 5-word windows) and fails the base rules or
not. Failures are counted per host, a host's rate is shrunk towards all hosts by a beta prior fitted to the hosts'
rates by moments, and documents of a host whose shrunk rate is above ``max_rate`` are rejected as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import batches, materialise, text_rows, word_ids

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_RATE = 0.5
BROADCAST_HOSTS = 100_000  # rejected hosts are broadcast up to this number
SALTS = 64  # beyond it, a host's documents are dealt into so many parts
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6  # bounds of the prior's weight in documents

_OUT = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))])


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows whose word sequence occurs at least twice. Windows are named exactly: a window of
    k + 1 words is the pair of its first k words' number and the next word, numbered anew by sorting."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    names = ids
    for k in range(1, window):
        pairs = names[: len(ids) - k] * (int(ids.max()) + 1) + ids[k:]
        names = np.unique(pairs, return_inverse=True)[1]
    twice = np.bincount(names)[names] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def measure(text: str) -> tuple[int, int, int, int, int]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, WHITE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip(WHITE)]
    known: dict = {}
    ids = word_ids(words, known)
    repeats = repeated_words(ids) if len(known) < len(words) else 0
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of ``docs`` with its measures and ``base_failed``. A null or empty text has no words and
    fails; a null ``doc_id`` or host stays null; repeated rows are measured one by one."""
    rows = text_rows(docs, F.col(host).cast("string").alias("host"))
    each = batches(lambda r: [(r[0], r[1], *measure(r[2]))], _ARROW, "doc_id", "host", "text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select("doc_id", "host", "text").mapInArrow(each, _OUT).withColumn("base_failed", failed)


def host_verdicts(rules: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Per known host: documents, failures, the shrunk rate and whether it is above ``max_rate``. Only
    two moments over hosts come to the driver. Without spread between hosts its weight is the greatest, so all hosts share one rate."""
    hosts = rules.filter("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread")).first()
    mean, weight = moments["mean"] or 0.0, MAX_STRENGTH
    if moments["spread"]:
        weight = max(MIN_STRENGTH, min(MAX_STRENGTH, mean * (1 - mean) / moments["spread"] - 1))
    shrunk = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.withColumn("rate", shrunk).withColumn("host_failed", F.col("rate") > max_rate)


def quality_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Measures, base verdict, host verdict and ``kept`` per row. Only rejected hosts are joined back: broadcast while
    their counted number allows, else with salted hosts, so that a busy host never goes to one task. A document
    without a host has no host verdict. The measures are checkpointed: texts are read and measured once."""
    rules = materialise(document_rules(docs, host))
    bad = materialise(host_verdicts(rules, max_rate).filter("host_failed").select(F.col("host").alias("bad_host")))
    if bad.count() <= broadcast_hosts:
        judged = rules.join(F.broadcast(bad), F.col("host") == F.col("bad_host"), "left")
    else:
        salted = bad.withColumn("bad_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
        rows = rules.withColumn("salt", salt)
        judged = rows.join(salted, (F.col("host") == F.col("bad_host")) & (F.col("salt") == F.col("bad_salt")), "left").drop("salt", "bad_salt")
    judged = judged.withColumn("host_failed", F.col("bad_host").isNotNull())
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("bad_host")
