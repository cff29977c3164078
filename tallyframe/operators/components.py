"""Weak components of a graph, whole and mended after changes, and keyed changes of its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import graph_stats, vertices
from .lineage_cut import written


def _pointers(links: DataFrame, salt: int) -> DataFrame:
    """(node, pointer): each end's neighbour, or itself, that comes first in an order of its own for each salt. A null end is no neighbour and points nowhere."""
    end = lambda one, other: F.struct(F.col(one).alias("node"), F.when(F.col(one).isNotNull(), F.coalesce(other, one)).alias("other"))
    placed = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("place"), F.col(c).alias("node"))
    around = links.select(F.explode(F.array(end("src", "dst"), end("dst", "src"))).alias("e")).select("e.*")
    return around.groupBy("node").agg(F.min(placed("other")).alias("first")).select("node", F.least("first", placed("node"))["node"].alias("pointer"))


def weak_components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """(node, component): the least node that each reaches along edges (src, dst) of either direction; nodes without edges are their own.

    Every node points to its first neighbour in a random order, and links become
    links of what their ends point to, until none is left: about half of the
    nodes of a path or a star are pointed to, so all rounds together shuffle a
    few times the links. Then pointers are followed back, round by round.
    """
    links, steps = written(edges.select("src", "dst"), "links"), []
    for i in range(rounds):
        steps.append(to := written(_pointers(links, i), "pointers"))
        a, b = to.toDF("src", "a"), to.toDF("dst", "b")
        moved = links.join(a, "src").join(b, "dst").where("a != b")
        links = written(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "links")
        if links.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = steps.pop()
    for i, to in enumerate(reversed(steps), 1):
        roots = to.join(roots.toDF("pointer", "root"), "pointer", "left").select("node", F.coalesce("root", "pointer").alias("pointer"))
        roots = written(roots, "roots") if i % 8 == 0 else roots
    roots = written(roots, "roots")
    least = roots.groupBy("pointer").agg(F.min("node").alias("component"))
    found = roots.join(least, "pointer", "left").select("node", "component")
    return found if nodes is None else nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def apply_changes(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """The edge table (id, src, dst, changed_at, ...) after changes of the same columns and `gone`: the newest row of an id counts.

    Of rows of one id and moment a removal counts before an addition, and changes
    before the table; applying the same changes again changes nothing.
    """
    columns = edges.columns
    both = edges.withColumns({"gone": F.lit(False), "__new": F.lit(0)}).unionByName(changes.select(*columns, "gone").withColumn("__new", F.lit(1)))
    row = F.struct(*columns, "gone")
    newest = both.groupBy("id").agg(F.max_by(row, F.struct("changed_at", "__new", "gone")).alias("row"))
    return newest.select("row.*").where("NOT gone").select(*columns)


def touched_nodes(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """(node): the ends, old and new, of the edges that changes name."""
    old = edges.join(changes.select("id").distinct(), "id").select("src", "dst")
    return vertices(old.unionByName(changes.select("src", "dst"))).where("node IS NOT NULL")


def mend_components(components: DataFrame, edges: DataFrame, touched: DataFrame) -> DataFrame:
    """Components of `edges`, the changed table, from those of the table before and the ends of changed edges.

    Only components that hold a touched node are built anew, from the edges
    within them; all others keep their rows. Nodes that have no edge any more go.
    """
    touched = written(touched, "touched")
    stale = components.join(touched, "node").select("component").distinct()
    inside = written(components.join(stale, "component").select("node").unionByName(touched.select("node")).distinct(), "inside")
    within = edges.select("src", "dst").join(inside, F.col("src") == F.col("node"), "left_semi")
    kept = components.join(inside, "node", "left_anti")
    return kept.select("node", "component").unionByName(weak_components(within))


def graph_summary(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """n_nodes, n_edges, avg_degree, density, n_components and largest_component of a graph."""
    sizes = weak_components(edges, nodes).groupBy("component").agg(F.count("*").alias("n"))
    parts = sizes.agg(F.count("*").alias("n_components"), F.max("n").alias("largest_component"))
    return graph_stats(edges).join(parts)
