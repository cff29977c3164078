"""Property-graph operators on edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage_cut import cut


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def graph_stats(edges: DataFrame) -> DataFrame:
    n_edges, n_nodes = edges.agg(F.count("*").alias("n_edges")), vertices(edges).agg(F.count("*").alias("n_nodes"))
    v, e = F.col("n_nodes"), F.col("n_edges")
    return n_edges.join(F.broadcast(n_nodes)).select("n_nodes", "n_edges", F.round(2 * e / v, 6).alias("avg_degree"), F.round(e / (v * (v - 1)), 6).alias("density"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Weighted PageRank by iterated join and aggregation; mass of nodes without out-edges is spread evenly."""
    edges = cut(edges)
    nodes = vertices(edges)
    n = nodes.agg(F.count("*").alias("n"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    ranks = nodes.join(F.broadcast(n)).select("node", "n", (1.0 / F.col("n")).alias("rank"))
    for _ in range(rounds):
        gained = ranks.join(share, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        idle = ranks.join(out.select("src"), F.col("node") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("idle"))
        spread = (1 - damping) / F.col("n") + damping * (F.coalesce("in", F.lit(0.0)) + F.col("idle") / F.col("n"))
        ranks = cut(ranks.join(gained, F.col("node") == F.col("to"), "left").join(F.broadcast(idle)).select("node", "n", spread.alias("rank")))
    return ranks.select("node", "rank")


def shortest_paths(edges: DataFrame, source: int, max_length: int = 5) -> DataFrame:
    """(node, hops) of the nodes within max_length of the source."""
    seen = edges.sparkSession.createDataFrame([(source, 0)], "node bigint, hops int")
    edges, frontier = cut(edges.select("src", "dst")), seen
    for d in range(1, max_length + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().withColumn("hops", F.lit(d))
        frontier = cut(step.join(seen.select("node"), "node", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def strongest_edges(edges: DataFrame, n: int) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(n)
