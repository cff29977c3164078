"""Betweenness and closeness of directed graphs, unweighted, by counts of shortest paths.

Sources are worked off in batches. Within a batch a breadth-first search runs
from all sources at once: each step joins the newest level, (source, node,
paths), with the edges. Levels are written, deepest last, and walked back: each
node passes on to its predecessors the share of paths that they hold. A batch's
tables have at most sources-of-a-batch times nodes rows, however many sources
there are. Edges that repeat and loops do not count; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import vertices
from .lineage_cut import written


def _levels(sources: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """(source, node, paths) of the nodes at distance 0, 1, 2 and so on."""
    levels = [written(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")), "level")]
    seen = levels[0].select("source", "node")
    while True:
        step = levels[-1].join(edges, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = written(step.join(seen, ["source", "node"], "left_anti"), "level")
        if level.isEmpty():
            return levels
        levels.append(level)
        seen = seen.unionByName(level.select("source", "node"))


def _shares(levels: list[DataFrame], edges: DataFrame) -> DataFrame | None:
    """(node, share): what each source's paths to all others leave at each node between, a row for each source and node."""
    below, out = None, None
    for i in range(len(levels) - 1, 0, -1):
        level, before = levels[i], levels[i - 1]
        held = level.select("source", F.col("node").alias("at"), F.col("paths").alias("through"))
        if below is not None:
            held = held.join(below.select("source", F.col("node").alias("at"), "share"), ["source", "at"], "left")
            held = held.withColumn("share", F.coalesce("share", F.lit(0.0)))
            mine = held.where("share > 0").select(F.col("at").alias("node"), "share")
            out = mine if out is None else out.unionByName(mine)
        else:
            held = held.withColumn("share", F.lit(0.0))
        passed = held.join(edges, F.col("at") == F.col("dst")).select("source", F.col("src").alias("node"), ((1 + F.col("share")) / F.col("through")).alias("part"))
        below = written(passed.join(before, ["source", "node"]).groupBy("source", "node").agg((F.sum("part") * F.first("paths")).alias("share")), "shares")
    return out


def centrality(edges: DataFrame, batch: int = 1024) -> DataFrame:
    """(node, betweenness, closeness, reached) of every node of an edge table (src, dst).

    Betweenness: over all ordered pairs, the share of shortest paths that pass
    the node. Closeness: one over the mean distance to the nodes it reaches along
    the edges; null if it reaches none.
    """
    edges = written(edges.select("src", "dst").where("src != dst AND src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    nodes = written(vertices(edges), "nodes")
    batches = max(1, math.ceil(nodes.count() / batch))
    far, between = [], []
    for i in range(batches):
        levels = _levels(nodes.where(F.pmod(F.xxhash64("node"), F.lit(batches)) == i), edges)
        distances = None
        for d, level in enumerate(levels[1:], 1):
            one = level.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n"), (F.count("*") * d).alias("hops"))
            distances = one if distances is None else distances.unionByName(one)
        if distances is not None:
            far.append(written(distances.groupBy("node").agg(F.sum("n").alias("reached"), F.sum("hops").alias("hops")), "far"))
        if (shares := _shares(levels, edges)) is not None:
            between.append(written(shares.groupBy("node").agg(F.sum("share").alias("share")), "between"))
    out = nodes
    for tables, columns in ((far, ["reached", "hops"]), (between, ["share"])):
        if tables:
            whole = tables[0]
            for more in tables[1:]:
                whole = whole.unionByName(more)
            out = out.join(whole.groupBy("node").agg(*(F.sum(c).alias(c) for c in columns)), "node", "left")
        else:
            out = out.withColumns({c: F.lit(None).cast("double") for c in columns})
    return out.select("node", F.coalesce("share", F.lit(0.0)).alias("betweenness"), (F.col("reached") / F.col("hops")).alias("closeness"), F.coalesce("reached", F.lit(0)).cast("bigint").alias("reached"))
