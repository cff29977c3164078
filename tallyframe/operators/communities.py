"""Communities of undirected weighted edges, by label propagation and by modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage_cut import cut, written


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): each round a node takes the heaviest label around it, ties to the smaller label."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    links = cut(both.where("src != dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    labels = links.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct()
    for _ in range(rounds):
        pull = links.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("w"))
        labels = cut(pull.groupBy("node").agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("community")))
    return labels


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Modularity of (node, community) on undirected edges (src, dst, weight); both directions of an edge add up."""
    a = communities.select(F.col("node").alias("src"), F.col("community").alias("from"))
    b = communities.select(F.col("node").alias("dst"), F.col("community").alias("to"))
    held = edges.join(a, "src").join(b, "dst")
    ends = held.select(F.col("from").alias("c"), "weight", F.when(F.col("from") == F.col("to"), 2 * F.col("weight")).otherwise(0.0).alias("inside")).unionByName(held.select(F.col("to").alias("c"), "weight", F.lit(0.0).alias("inside")))
    row = ends.groupBy("c").agg(F.sum("weight").alias("k"), F.sum("inside").alias("i")).agg(F.sum("k").alias("m2"), F.sum("i").alias("i"), F.sum(F.col("k") * F.col("k")).alias("kk")).first()
    return 0.0 if not row["m2"] else row["i"] / row["m2"] - row["kk"] / row["m2"] ** 2


def _moves(links: DataFrame, state: DataFrame, m2: float, turn: int) -> DataFrame:
    """(node, to) of the nodes that gain by moving, but for those whose gain a neighbour's larger one takes away: one that leaves their aim, or enters what they leave.

    links: (node, other, w) in both directions, without loops. state: (node, community, k).
    """
    totals = state.groupBy("community").agg(F.sum("k").alias("total"))
    around = links.join(state.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("w").alias("w"))
    own = state.select("node", F.col("community").alias("own"), "k")
    # the own community may hold no neighbour
    choices = around.join(own, "node").join(totals, "community")
    worth = F.col("w") - F.col("k") * (F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)) / m2
    valued = choices.select("node", "own", "community", worth.alias("worth"))
    best = valued.where("community != own").groupBy("node", "own").agg(F.max(F.struct(F.round("worth", 9).alias("worth"), (-F.col("community")).alias("less"))).alias("best"))
    staying = own.join(totals.withColumnRenamed("community", "own"), "own").select("node", (-F.col("k") * (F.col("total") - F.col("k")) / m2).alias("alone"))
    here = valued.where("community = own").select("node", F.col("worth").alias("here"))
    wish = best.join(staying, "node").join(here, "node", "left").select("node", "own", (-F.col("best.less")).alias("to"), (F.col("best.worth") - F.coalesce("here", "alone")).alias("gain")).where("gain > 1e-7")
    rank = F.struct(F.round("gain", 9).alias("gain"), F.xxhash64("node", F.lit(turn)).alias("lot"), "node")
    wish = written(wish.select("node", "own", "to", rank.alias("rank")), "wish")
    others = wish.select(F.col("node").alias("other"), F.col("own").alias("left"), F.col("to").alias("entered"), F.col("rank").alias("theirs"))
    rivals = links.join(wish, "node").join(others, "other").where("theirs > rank AND (left = to OR entered = own)").select("node").distinct()
    return wish.join(rivals, "node", "left_anti").select("node", "to")


def _level(links: DataFrame, nodes: DataFrame, m2: float, rounds: int) -> tuple[DataFrame, float]:
    """((node, community), modularity) after local moves from (node, community, k): nodes move together while modularity rises."""
    state, turn = written(nodes, "state"), 0

    def quality(state: DataFrame) -> float:
        within = links.join(state.select("node", "community"), "node").join(state.select(F.col("node").alias("other"), F.col("community").alias("theirs")), "other").where("community = theirs").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        return within / m2 - state.groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] / m2**2

    now, misses = quality(state), 0
    while turn < rounds and misses < 3:
        turn += 1
        moves = written(_moves(links, state, m2, turn), "moves")
        if moves.isEmpty():
            break
        if misses:  # what moved together did harm: try a share of it
            moves = moves.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2**misses)) == 0)
        after = written(state.join(moves, "node", "left").select("node", F.coalesce("to", "community").alias("community"), "k"), "state")
        if (then := quality(after)) > now + 1e-12:
            state, now, misses = after, then, 0
        else:
            misses += 1
    return state.select("node", "community"), now


def louvain(edges: DataFrame, rounds: int = 60, levels: int = 12, passes: int = 3) -> DataFrame:
    """(node, community) by the Louvain method on undirected edges (src, dst, weight); a community is named by its least node.

    Nodes move to the neighbouring community of the largest gain in modularity,
    ties to the smallest; of neighbours whose moves spoil each other only the one
    of the larger gain moves. When nothing gains, communities become the nodes of a
    smaller graph. A pass that gained is followed by one that starts from its
    communities. Integer nodes; weights above 0, loops and repeats add up.
    """
    whole = written(edges.where("weight > 0 AND src IS NOT NULL AND dst IS NOT NULL").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").cast("double").alias("weight")), "pairs")
    m2 = 2 * (whole.agg(F.sum("weight")).first()[0] or 0.0)
    member = written(whole.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("community")), "member")
    reached = -1.0
    for _ in range(passes if m2 else 0):
        pairs, start, best = whole, member, reached
        member = member.select("node", F.col("node").alias("community"))
        for _ in range(levels):
            loops = pairs.where("src = dst").select(F.col("src").alias("node"), (2 * F.col("weight")).alias("k"))
            apart = pairs.where("src != dst")
            links = written(apart.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.col("weight").alias("w")).unionByName(apart.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.col("weight").alias("w"))), "links")
            nodes = links.select("node", F.col("w").alias("k")).unionByName(loops).groupBy("node").agg(F.sum("k").alias("k"))
            nodes = nodes.join(start, "node") if start is not None else nodes.withColumn("community", F.col("node"))
            moved, reached = _level(links, nodes, m2, rounds)
            found = written(moved, "found")
            if start is None and found.where("node != community").isEmpty():
                break
            start = None
            member = written(member.join(found.select(F.col("node").alias("community"), F.col("community").alias("next")), "community").select("node", F.col("next").alias("community")), "member")
            a, b = found.select(F.col("node").alias("src"), F.col("community").alias("a")), found.select(F.col("node").alias("dst"), F.col("community").alias("b"))
            joined = pairs.join(a, "src").join(b, "dst")
            pairs = written(joined.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight")), "pairs")
        if reached <= best + 1e-9:
            break
    name = member.groupBy("community").agg(F.min("node").alias("name"))
    return member.join(name, "community").select("node", F.col("name").alias("community"))
