"""Connected components of an edge table, by alternating star contractions.

Each round links every vertex's larger neighbours to its smallest one, then
its smaller neighbours to the smallest. Only edge tables move; minima are
aggregated before the shuffle, so a vertex with very many links costs one row
per task. Rounds end when the edges stop changing, after about log n of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Tables


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _mark(edges: DataFrame):
    """Count and sum of hashes: equal for equal edge tables."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component): the smallest vertex that each vertex of an edge table (a, b) reaches."""
    tables = Tables(edges.sparkSession)
    now = tables.write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    mark = _mark(now)
    for i in range(max_rounds):
        now = tables.write(_small_star(_large_star(now)), f"edges{i + 1}")
        tables.drop(f"edges{i}")
        if (after := _mark(now)) == mark:
            break
        mark = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
