"""Maximum inner product search by score-aware quantisation.

Vectors are cut into small subspaces with 16 centres each. Centres and codes
minimise a loss that weighs the part of the residual parallel to the vector
more than the rest, as that part is what changes large inner products. A query
turns the centres into a table of 256 partial scores for each byte of two
four-bit codes and scans all codes by table lookups. Its best `shortlist` are a
first guess: their exact inner products give a k-th best score, and every vector
whose quantised score plus |query| * |residual| reaches it is scored exactly too,
so the result is exact also where many codes coincide.

Centres are fitted on a bounded sample (`sample` rows with the smallest hash of
their id); every row is encoded and scanned. Queries and codes meet in blocks.

Vectors that are null or zero, or hold null or non-finite components, or whose
length is not the most common one of the table (of equally common ones the
smaller), take no part. Components are scored in double precision, as the table
has them. Equal scores go to the smaller id. Rows that repeat an id are separate
queries and separate candidates, told apart by a number given to each row when
the vectors are written; a query never finds its own row. An empty table gives an
empty result. Columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise
from .tokens import small_batches

#: Centres of a subspace: a code has four bits.
CENTRES = 16
#: Rows that the centres are fitted on, codes in a block, queries in a block, and codes that one task scans for a block of queries.
SAMPLE, CODE_BLOCK, QUERY_BLOCK, TASK_CODES = 10_000, 4096, 512, 4_000_000


@dataclass
class Quantiser:
    """cuts: bounds of the subspaces; centres: (16, width) for each; eta: weight of the parallel residual."""

    cuts: list[tuple[int, int]]
    centres: list[np.ndarray]
    eta: float

    @property
    def width(self) -> int:
        return self.cuts[-1][1]

    def _excess(self, x: np.ndarray) -> np.ndarray:
        return (self.eta - 1) / (x * x).sum(axis=1)

    def assign(self, x: np.ndarray, codes: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the loss, from the nearest centres or from given codes."""
        excess = self._excess(x)
        if codes is None:
            codes = np.stack([((x[:, None, a:b] - c[None]) ** 2).sum(axis=2).argmin(axis=1) for (a, b), c in zip(self.cuts, self.centres, strict=True)], axis=1)
        parallel = sum((((x[:, a:b] - c[codes[:, m]]) * x[:, a:b]).sum(axis=1) for m, ((a, b), c) in enumerate(zip(self.cuts, self.centres, strict=True))), np.zeros(len(x)))
        for _ in range(sweeps):
            for m, ((a, b), c) in enumerate(zip(self.cuts, self.centres, strict=True)):
                part = x[:, a:b]
                along = (part * part).sum(axis=1)[:, None] - part @ c.T
                square = along - part @ c.T + (c * c).sum(axis=1)
                rest = parallel - along[np.arange(len(x)), codes[:, m]]
                codes[:, m] = (square + excess[:, None] * (rest[:, None] + along) ** 2).argmin(axis=1)
                parallel = rest + along[np.arange(len(x)), codes[:, m]]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Least squares of each subspace's centres under the loss, one subspace after another."""
        excess = self._excess(x)
        off = [((x[:, a:b] - c[codes[:, m]]) * x[:, a:b]).sum(axis=1) for m, ((a, b), c) in enumerate(zip(self.cuts, self.centres, strict=True))]
        parallel = np.sum(off, axis=0)
        for m, (a, b) in enumerate(self.cuts):
            part, rest = x[:, a:b], parallel - off[m]
            pull = part + (excess * (rest + (part * part).sum(axis=1)))[:, None] * part
            for k in range(CENTRES):
                mine = codes[:, m] == k
                if mine.any():
                    p = part[mine]
                    self.centres[m][k] = np.linalg.solve(mine.sum() * np.eye(b - a) + (p * excess[mine, None]).T @ p, pull[mine].sum(axis=0))
            off[m] = ((part - self.centres[m][codes[:, m]]) * part).sum(axis=1)
            parallel = rest + off[m]

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte; an odd last code stands alone."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], axis=1)
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def reach(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For each vector, what a query of length 1 can gain at most over its quantised score; rounding of float32 sums is within."""
        lost, held = np.zeros(len(x)), np.zeros(len(x))
        for m, ((a, b), c) in enumerate(zip(self.cuts, self.centres, strict=True)):
            centre = c[codes[:, m]]
            lost += ((x[:, a:b] - centre) ** 2).sum(axis=1)
            held += (centre * centre).sum(axis=1)
        lost, held = np.sqrt(lost), np.sqrt(held)
        return np.nextafter((lost + (self.width + 8) * 1.2e-7 * (lost + held)).astype(np.float32), np.float32(np.inf))

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each byte of packed codes, (256, queries) partial scores."""
        single = [(c @ queries[:, a:b].T).astype(np.float32) for (a, b), c in zip(self.cuts, self.centres, strict=True)]
        if len(single) % 2:
            single.append(np.zeros_like(single[0]))
        return [(low[None, :, :] + high[:, None, :]).reshape(256, -1) for low, high in zip(single[0::2], single[1::2], strict=True)]


def fit(sample: np.ndarray, subspaces: int | None = None, threshold: float = 0.2, rounds: int = 6, seed: int = 5) -> Quantiser:
    """threshold: share of a vector's length above which inner products should be kept well; it sets eta."""
    width = sample.shape[1]
    subspaces = subspaces or width
    edges = np.linspace(0, width, subspaces + 1).round().astype(int)
    rng = np.random.default_rng(seed)
    start = sample[rng.choice(len(sample), CENTRES, replace=len(sample) < CENTRES)]
    cuts = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    eta = max(1.0, (width - 1) * threshold**2 / (1 - threshold**2))
    model = Quantiser(cuts, [start[:, a:b].copy() for a, b in cuts], 1.0)
    codes = None
    for i in range(rounds):
        model.eta = eta if i >= rounds // 2 else 1.0  # plain least squares first
        codes = model.assign(sample, codes, sweeps=1)
        model.refit(sample, codes)
    return model


def valid_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, row, v) of the rows that take part, but for their length; a component is as the table has it, float or double."""
    wide = "double" in table.schema[vector].dataType.simpleString()
    v = F.col(f"`{vector}`").cast("array<double>" if wide else "array<float>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    held = table.select(F.col(f"`{key}`").cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    return held.select("id", F.monotonically_increasing_id().alias("row"), "v")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit_on_sample(vectors: DataFrame, sample: int = SAMPLE, **how) -> Quantiser:
    """vectors: of one length."""
    rows = [r["v"] for r in vectors.orderBy(F.xxhash64("id"), "id", "row").limit(sample).collect()]
    x = np.array(rows, dtype=np.float64)
    return fit(x[np.abs(x).max(axis=1) < 1e150] if (np.abs(x) < 1e150).any() else x, **how)


BLOCKS = ("ids", "rows", "codes", "reach", "vectors")


def code_blocks(vectors: DataFrame, model: Quantiser, block: int = CODE_BLOCK) -> DataFrame:
    """(ids, rows, codes, reach, vectors): up to `block` vectors in a row with their packed codes, by rising id."""
    number = "<f8" if "double" in vectors.schema["v"].dataType.simpleString() else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids, x = part.column("id").to_numpy(), _matrix(part.column("v"), model.width)
                order = np.argsort(ids, kind="stable")
                with np.errstate(over="ignore", invalid="ignore"):  # huge components have no bound and are scored exactly
                    codes = model.assign(x.astype(np.float64))
                    reach = model.reach(x.astype(np.float64), codes)
                held = ids.astype("<i8"), part.column("row").to_numpy().astype("<i8"), model.pack(codes), reach.astype("<f4"), x.astype(number)
                yield pa.RecordBatch.from_arrays([pa.array([h[order].tobytes()], pa.binary()) for h in held], names=[*BLOCKS])

    return vectors.transform(small_batches).mapInArrow(run, ", ".join(f"{c} binary" for c in BLOCKS))


class Best:
    """The k candidates of largest exact inner product with one query; equal ones by smaller id."""

    def __init__(self, query_id: int, row: int, vector: np.ndarray, k: int):
        self.query_id, self.row, self.vector, self.k = query_id, row, vector, k
        self.ids, self.scores, self.least = np.zeros(0, np.int64), np.zeros(0), -np.inf

    def score(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = np.einsum("ij,j->i", vectors.astype(np.float64), self.vector)
        fine = scores >= self.least
        ids, scores = np.concatenate([self.ids, ids[fine]]), np.concatenate([self.scores, scores[fine]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = self.scores[-1]

    def scan(self, ids: np.ndarray, rows: np.ndarray, near: np.ndarray, most: np.ndarray, vectors: np.ndarray, shortlist: int) -> None:
        """near: quantised scores; most: what the exact ones can be at most. Scores by `shortlist` first, then all that can still be among the best."""
        left = np.flatnonzero(~(most < self._floor()) & (rows != self.row))
        if len(left) > shortlist:
            cut = np.argpartition(near[left], len(left) - shortlist)
            guess, left = left[cut[-shortlist:]], left[cut[:-shortlist]]
            self.score(ids[guess], vectors[guess])
            left = left[~(most[left] < self._floor())]
        for at in range(0, len(left), CODE_BLOCK):
            some = left[at : at + CODE_BLOCK]
            self.score(ids[some], vectors[some])

    def _floor(self) -> np.float32:
        return np.nextafter(np.float32(self.least), np.float32(-np.inf))


def best_in_cells(queries: DataFrame, blocks: DataFrame, model: Quantiser, n_queries: int, n_codes: int, k: int, shortlist: int) -> DataFrame:
    """(query_id, query_row, vec_id, score): each query's k best of each group of code blocks, per block of queries."""
    number = "<f8" if "double" in queries.schema["v"].dataType.simpleString() else "<f4"
    n_blocks, groups = -(-n_queries // QUERY_BLOCK), -(-n_codes // TASK_CODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, tables, lengths = None, [], None, None

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array(np.repeat([getattr(q, name) for q in asked], [len(q.ids) for q in asked]).astype(np.int64)) for name in ("query_id", "row")), pa.array(np.concatenate([q.ids for q in asked])), pa.array(np.concatenate([q.scores for q in asked]))],
                names=["query_id", "query_row", "vec_id", "score"],
            )

        for batch in batches:
            for row in range(batch.num_rows):
                b, g, q, own, v, ids, rows, codes, reach, vectors = (batch.column(c)[row].as_py() for c in ("b", "g", "q", "own", "v", *BLOCKS))
                if (b, g) != cell:
                    if asked:
                        yield found()
                    cell, asked, tables = (b, g), [], None
                if q is not None:  # the queries of a cell come first
                    asked.append(Best(q, own, np.array(v, dtype=np.float64), k))
                    continue
                if not asked:
                    continue
                if tables is None:
                    whole = np.array([a.vector for a in asked])
                    tables = model.tables(whole)
                    lengths = np.nextafter(np.sqrt((whole * whole).sum(axis=1)).astype(np.float32), np.float32(np.inf))
                ids, rows, codes = np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8"), np.frombuffer(codes, np.uint8).reshape(len(ids) // 8, -1)
                reach, vectors = np.frombuffer(reach, "<f4"), np.frombuffer(vectors, number).reshape(len(ids), -1)
                score = tables[0][codes[:, 0]]
                for j in range(1, codes.shape[1]):
                    score += tables[j][codes[:, j]]
                score = np.ascontiguousarray(score.T)
                for a, near, length in zip(asked, score, lengths, strict=True):
                    a.scan(ids, rows, near, near + length * reach, vectors, shortlist)
        if asked:
            yield found()

    nothing = F.lit(None)
    ask = queries.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.col("id").alias("q"), F.col("row").alias("own"), "v", *(nothing.cast("binary").alias(c) for c in BLOCKS))
    held = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("g"), nothing.cast("bigint").alias("q"), nothing.cast("bigint").alias("own"), nothing.cast(queries.schema["v"].dataType).alias("v"), *BLOCKS)
    dealt = ask.unionByName(held).repartition("b", "g").sortWithinPartitions("b", "g", F.col("q").asc_nulls_last())
    return dealt.transform(small_batches).mapInArrow(run, "query_id bigint, query_row bigint, vec_id bigint, score double")


def search(table: DataFrame, is_query, k: int = 20, shortlist: int = 250, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """Per query, its k candidates of largest inner product: query_id, rank from 1, vec_id, score.

    is_query: condition on the column `id`, a row's id as a bigint.
    """
    vectors = materialise(valid_vectors(table, key, vector), "vectors")
    nothing = vectors.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    lengths = vectors.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"))
    common = lengths.orderBy(F.desc("n"), "width").first()
    if common is None or not common["q"]:
        return nothing
    vectors = vectors.where(F.size("v") == common["width"])
    model = fit_on_sample(vectors, sample)
    scored = best_in_cells(vectors.where(is_query), code_blocks(vectors, model), model, common["q"], common["n"], k, shortlist)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
