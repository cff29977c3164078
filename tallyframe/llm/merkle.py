"""A manifest of a dataset: Merkle trees of its rows, one per value of a column, and a proof for every row.

Each row is a leaf, the SHA-256 of its fields. The leaves of one tree stand in
the order of the key; while several nodes remain, every eight consecutive ones
become their digest (the last run may be shorter). The roots of the trees, in
the order of the tree column, are the leaves of one more tree, whose root
stands for the whole dataset.

Trees are worked off in aligned blocks of 512 nodes, whatever the size of a
tree. A first pass takes each block's root with a treehash stack; the roots
are the nodes of the next, 512 times smaller table, until one node is left.
A second pass walks each block leaf by leaf: at every level it holds the
current run of siblings, while that level's treehash stack takes in one leaf of
the next run per step, so that the run is complete when the walk enters it.
Besides the block's digests it holds a number of nodes logarithmic in the block.
The path of the block's root, computed once for the block, is appended.

Null fields count as "-", which no value is written as. A null tree value is a
tree of its own, the first; null keys stand first in their tree. Rows that tie
in key and leaf are put in a fixed order and each get a proof. A tree of one row
has that leaf as its root. An empty table gives an empty result. Columns that
are not named are not read, and whatever the columns are called, names cannot
clash with the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered
from .store import Tables

#: Nodes of a run, levels of a block, and nodes of a block.
ARITY, HEIGHT = 8, 3
BLOCK = ARITY**HEIGHT
PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def field(column: Column) -> Column:
    """A value as its UTF-8 byte count, ":" and the value, or "-" for null: no two rows are written alike."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the fields."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, digest, lambda at, run: F.sha2(F.concat(run["left"], at, run["right"]), 256))


class Treehash:
    """Nodes of one level, made of leaves given one by one; at most seven nodes wait at each level below."""

    def __init__(self, level: int):
        self.waiting: list[list[str]] = [[] for _ in range(level)]
        self.nodes: list[str] = []

    def feed(self, digest: str) -> None:
        for run in self.waiting:
            run.append(digest)
            if len(run) < ARITY:
                return
            digest = sha256("".join(run).encode()).hexdigest()
            run.clear()
        self.nodes.append(digest)

    def take(self) -> list[str]:
        """The nodes; leaves that wait are the last ones of all and make a shorter run at each level."""
        last = None
        for run in self.waiting:
            if last is not None:
                run.append(last)
            last = sha256("".join(run).encode()).hexdigest() if run else None
            run.clear()
        nodes, self.nodes = self.nodes + ([] if last is None else [last]), []
        return nodes


def height(n: int) -> int:
    """Levels above the nodes of a block, in a tree that has n nodes beside each other at the block's foot."""
    return next(h for h in range(HEIGHT + 1) if h == HEIGHT or ARITY**h >= n)


def walk(digests: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in order the digests left and right of its path, level by level."""
    spans = [ARITY ** (level + 1) for level in range(levels)]
    runs, coming, sides = [], [Treehash(level) for level in range(levels)], [("", "")] * levels
    for level, span in enumerate(spans):
        first = Treehash(level)
        for digest in digests[:span]:
            first.feed(digest)
        runs.append(first.take())
    for i in range(len(digests)):
        for level, span in enumerate(spans):
            if i and i % span == 0:
                runs[level] = coming[level].take()
            at, inside = divmod(i % span, span // ARITY)
            if not inside:
                sides[level] = "".join(runs[level][:at]), "".join(runs[level][at + 1 :])
            if i + span < len(digests):
                coming[level].feed(digests[i + span])
        yield list(sides)


def _block_root(nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("idx")
    n, tree, block = (nodes.column(c)[0].as_py() for c in ("n", "tree", "block"))
    stack = Treehash(height(n))
    for digest in nodes.column("digest").to_pylist():
        stack.feed(digest)
    return pa.table({"tree": pa.array([tree], pa.int64()), "idx": pa.array([block], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": stack.take()})


def _block_paths(nodes: pa.Table, upper: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("idx")
    above = [(x["left"], x["right"]) for x in upper.column("path")[0].as_py()]
    paths = [low + above for low in walk(nodes.column("digest").to_pylist(), height(nodes.column("n")[0].as_py()))]
    flat, m = [side for path in paths for side in path], nodes.num_rows
    sides = pa.StructArray.from_arrays([pa.array([s[i] for s in flat], pa.string()) for i in (0, 1)], names=["left", "right"])
    nodes = nodes.append_column("path", pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, len(flat) // m) if flat else [0] * (m + 1), pa.int32()), sides).cast(_PATH))
    for name in ("subroot", "root"):
        nodes = nodes.append_column(name, pa.array([upper.column(name)[0].as_py()] * m, pa.string()))
    return nodes


def _climb(nodes: DataFrame, tables: Tables, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tables of nodes that the blocks of one another are made of, and (tree, digest) of the roots."""
    levels, roots = [nodes.withColumn("block", F.expr(f"idx div {BLOCK}"))], []
    while True:
        made = levels[-1].select("tree", "block", "idx", "n", "digest").groupBy("tree", "block").applyInArrow(_block_root, "tree bigint, idx bigint, n bigint, digest string")
        made = tables.write(made, f"{name}_roots{len(levels)}")
        roots.append(made.where("n = 1").select("tree", "digest"))
        rest = made.where("n > 1")
        if rest.isEmpty():
            break
        levels.append(rest.withColumn("block", F.expr(f"idx div {BLOCK}")))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return levels, found


def _descend(levels: list[DataFrame], tops: DataFrame, tables: Tables, name: str) -> DataFrame:
    """levels[0] with path, subroot and root. tops: (tree, path, subroot, root) of each tree's root."""
    below = None
    for i in reversed(range(len(levels))):
        ends = levels[i].where(f"n <= {BLOCK} AND idx = 0").select("tree")
        upper = tops.join(ends, "tree").select("tree", F.lit(0).cast("bigint").alias("block"), "path", "subroot", "root")
        if below is not None:
            upper = upper.unionByName(below.select("tree", F.col("idx").alias("block"), "path", "subroot", "root"))
        upper = tables.write(upper, f"{name}_upper{i}")
        schema = levels[i].schema.simpleString()[len("struct<") : -1] + f",path:{PATH},subroot:string,root:string"
        below = levels[i].groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(_block_paths, f"struct<{schema}>")
    return below


def manifest(docs: DataFrame, fields: list[str], tree: str = "lang", key: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """Per row: the key, the columns of `carry` (computed from the row), leaf, subroot (the root of its tree), root and proof.

    A proof lists, from the leaf up to the root, the joined digests that stand
    left and right of the path in each run; `fold` leads from a leaf to the root.
    """
    carry, tables = carry or {}, Tables(docs.sparkSession)
    made = [c.alias(f"c{i}") for i, c in enumerate(carry.values())]
    rows = docs.select(docs[tree].alias("value"), docs[key].alias("key"), leaf(*(docs[f] for f in fields)).alias("digest"), F.monotonically_increasing_id().alias("tie"), *made)
    rows = tables.write(rows, "rows")  # fixes the order of ties
    leaves = numbered(rows.withColumnRenamed("value", "tree"), ["tree"], ["key", "digest", "tie"], tables, "leaves", "idx", "n")

    values = leaves.where("idx = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("value"))
    trees = tables.write(numbered(values, ["tree"], ["value"], tables, "trees", "idx", "n").select(F.col("idx").alias("id"), "value", "n"), "trees")
    leaves = leaves.join(trees.select("id", "value"), F.col("tree").eqNullSafe(F.col("value"))).drop("tree", "value", "tie").withColumnRenamed("id", "tree")
    leaves = tables.write(leaves, "leaves")
    tables.drop("rows", "leaves_sorted", "leaves_starts")

    levels, subroots = _climb(leaves, tables, "rows")
    subroots = tables.write(subroots.join(trees, F.col("tree") == F.col("id")).select(F.lit(0).cast("bigint").alias("tree"), F.col("id").alias("idx"), "n", "digest"), "subroots")
    upper, root = _climb(subroots, tables, "trees")
    top = root.select("tree", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    tops = tables.write(_descend(upper, top, tables, "trees").select(F.col("idx").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "tops")
    found = _descend(levels, tops, tables, "rows")
    return found.select(F.col("key").alias(key), *(F.col(f"c{i}").alias(name) for i, name in enumerate(carry)), F.col("digest").alias("leaf"), "subroot", "root", F.col("path").alias("proof"))
