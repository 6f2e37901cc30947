"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir); all but the last return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.names import free
from ravelin.llm import bestfit, fmquality, secretscan, sigjoin, windowdedup
from ravelin.llm.common import fresh_path, table

NEAR_PERCENT = 80  # similarity of near duplicates in the corpus; the 85 of sigjoin.PERCENT is of op6's query only


def written(docs: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder, read again."""
    spark = docs.sparkSession
    path = fresh_path(spark, name)
    docs.write.parquet(path)
    return spark.read.parquet(path)


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text; it stays null where it was."""
    return docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(F.coalesce("text", F.lit(""))).cast("long")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on this corpus, scores below its threshold go."""
    model = fmquality.fit_on(docs, table(spark, sf_dir, "labels"))
    (score,) = free(docs, "score")
    return fmquality.score(docs, model, into=score).filter(F.col(score) >= fmquality.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked at NEAR_PERCENT, the document with the smallest doc_id stays. Rows that share a doc_id are one
    document: they go together, if any of them is a duplicate of a smaller doc_id; rows without a doc_id stay."""
    (name,) = free(docs, "gone")
    gone = sigjoin.near_duplicates(docs, NEAR_PERCENT).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def strip_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur earlier go; what is left of a changed text is joined by single spaces, other
    texts stay as they are. A text that loses all its words goes."""
    part = (F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_words"))
    classes = windowdedup.strip_repeats(docs).withColumn("kept", F.when(part, F.col("kept")))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), windowdedup.text_key(F.col("text")).alias("key"))
    out = windowdedup.judged(rows, classes, windowdedup.WINDOW, "kept").filter("n_removed = 0 OR n_removed < n_words")
    text = F.when(part, F.col("kept")).otherwise(F.col("doc.text")).alias("text")
    return with_length(out.select(*(text if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns)))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret gives way to a mark of its kind; all documents stay."""
    return with_length(secretscan.redact(docs))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the training set: which words of which document lie where."""
    return bestfit.pack_documents(docs)
