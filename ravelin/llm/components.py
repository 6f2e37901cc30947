"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import materialise


def _large_star(links: DataFrame) -> DataFrame:
    """Every vertex points its larger neighbours to the least of itself and its neighbours."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every vertex points itself and its smaller neighbours to the least of them; links run from large to small."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = links.join(least, F.col("a") == F.col("u")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``links`` (a, b) but the roots, the least vertices of their components.
    Each round is checkpointed; their number grows with the logarithm of the links, and only a count and a check sum
    come to the driver."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    seen = None
    while True:
        links = materialise(_small_star(_large_star(links)))
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return links.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        seen = now
