"""Matrix profiles of many series, and what they show: motifs and changes of regime.

A series is (key, position, value) with positions 0, 1, 2 and so on. Its profile
has, for each window of m values, the nearest other window by the distance of
the two with mean and scale removed, windows that overlap too much left out.

Series are cut into chunks that share m - 1 values with the next one, and every
two chunks of a series meet in one tile, which is a matrix product. So a long
series is dealt over many tasks, and no task holds more than two chunks. All
windows meet all others: work grows with the square of a series, by definition.

Windows of equal values have no shape: two of them are 0 apart, one and another
kind sqrt(m). Distances are rounded to 6 digits, and of equal ones the earliest
window counts. Series shorter than two windows have no profile. Values must not
be null; a null key is a series of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage_cut import written

#: Windows in a chunk.
CHUNK = 1024


def zone(m: int) -> int:
    """Windows that start no farther apart than this are not compared."""
    return math.ceil(m / 4)


def shapes(values: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows with mean 0 and length 1, whether a window is flat)."""
    x = np.lib.stride_tricks.sliding_window_view(values, m).astype(np.float64)
    flat = x.max(axis=1) == x.min(axis=1)
    x = x - x.mean(axis=1, keepdims=True)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(flat[:, None], 0.0, x / np.where(length > 0, length, 1.0)), flat


def tile(first: np.ndarray, second: np.ndarray, m: int, apart: int) -> np.ndarray:
    """Distances of the windows of two stretches; the second starts `apart` values after the first. Excluded ones are infinite."""
    (a, flat_a), (b, flat_b) = shapes(first, m), shapes(second, m)
    d = np.sqrt(np.maximum(0.0, 2 * m * (1 - a @ b.T)))
    d[flat_a[:, None] ^ flat_b[None, :]] = math.sqrt(m)
    d[flat_a[:, None] & flat_b[None, :]] = 0.0
    between = np.arange(len(b))[None, :] + apart - np.arange(len(a))[:, None]
    return np.where(np.abs(between) <= zone(m), np.inf, np.round(d, 6))


def matrix_profile(series: DataFrame, key: str, position: str, value: str, m: int, chunk: int = CHUNK) -> DataFrame:
    """(key, position, distance, neighbour) of every window; no row for a window that has no other to be compared with."""
    rows = series.select(F.col(key).alias("key"), F.col(position).cast("bigint").alias("at"), F.col(value).cast("double").alias("x"))
    least = F.greatest(F.lit(0).cast("bigint"), F.expr(f"(at - {m - 1}) div {chunk}"))
    dealt = rows.withColumn("chunk", F.explode(F.sequence(least, F.expr(f"at div {chunk}"))))
    chunks = dealt.groupBy("key", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("values"))
    chunks = written(chunks.where(F.size("values") >= m), "chunks")
    other = chunks.select(F.col("key").alias("other_key"), F.col("chunk").alias("other"), F.col("values").alias("others"))
    tiles = chunks.join(other, F.col("key").eqNullSafe(F.col("other_key")) & (F.col("chunk") <= F.col("other"))).select("key", "chunk", "other", "values", "others")
    kind = chunks.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("chunk")[i].as_py(), batch.column("other")[i].as_py()
                d = tile(*(np.array(batch.column(c)[i].values) for c in ("values", "others")), m, (b - a) * chunk)
                sides = [(d, a, b)] if a == b else [(d, a, b), (d.T, b, a)]
                for x, own, theirs in sides:
                    nearest = x.argmin(axis=1)
                    best = x[np.arange(len(x)), nearest]
                    some = np.flatnonzero(np.isfinite(best))
                    if len(some):
                        keys = pa.repeat(batch.column("key")[i], len(some)) if batch.column("key")[i].is_valid else pa.nulls(len(some), batch.column("key").type)
                        yield pa.RecordBatch.from_arrays([keys, pa.array(some + own * chunk), pa.array(best[some]), pa.array(nearest[some] + theirs * chunk)], names=["key", "at", "distance", "neighbour"])

    found = tiles.repartition("key", "chunk", "other").mapInArrow(run, f"key {kind}, at bigint, distance double, neighbour bigint")
    nearest = found.groupBy("key", "at").agg(F.min(F.struct("distance", "neighbour")).alias("best"))
    return nearest.select(F.col("key").alias(key), F.col("at").alias(position), "best.distance", "best.neighbour")


def lowest(points: DataFrame, key: str, position: str, value: str, k: int, apart: int, also: str | None = None) -> DataFrame:
    """points with the k lowest values of each key, no two within `apart` positions of each other (nor of the column `also`), with their rank from 1."""
    left, out = written(points, "points"), None
    for rank in range(1, k + 1):
        row = F.struct(*(F.col(c) for c in [value, position, *(c for c in points.columns if c not in (key, value, position))]))
        best = written(left.groupBy(key).agg(F.min(row).alias("best")), "best")
        found = best.select(F.col(key), *(F.col("best")[c].alias(c) for c in points.columns if c != key), F.lit(rank).alias("rank"))
        out = found if out is None else out.unionByName(found)
        if rank < k:
            taken = best.select(F.col(key).alias("__key"), F.col("best")[position].alias("__at"), *([F.col("best")[also].alias("__also")] if also else []))
            near = F.abs(F.col(position) - F.col("__at")) <= apart
            near = near | (F.abs(F.col(position) - F.col("__also")) <= apart) if also else near
            left = left.join(taken, F.col(key).eqNullSafe(F.col("__key"))).where(~near).drop("__key", "__at", "__also")
    return out


def motifs(profile: DataFrame, key: str, position: str, m: int, k: int = 3) -> DataFrame:
    """The k closest pairs of windows of each series: position, neighbour, distance and rank; windows near a taken one are left out."""
    return lowest(profile, key, position, "distance", k, zone(m), also="neighbour")


def motif_periods(series: DataFrame, key: str, position: str, value: str, sizes: tuple[int, ...] = (7, 14, 30), least: float = 0.5) -> DataFrame:
    """(key, period, confidence): the first window size whose best distance is below half of the worst one, with one less their ratio."""
    lengths = series.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    out = None
    for i, m in enumerate(sizes):
        long = series.join(lengths.where(F.col("__n") >= 2 * m), F.col(key).eqNullSafe(F.col("__key"))).drop("__key", "__n")
        ends = matrix_profile(long, key, position, value, m).groupBy(key).agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
        one = ends.where("high > 0").select(key, F.lit(i).alias("i"), F.lit(m).alias("period"), (1 - F.col("low") / F.col("high")).alias("confidence")).where(F.col("confidence") > least)
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min_by(F.struct("period", "confidence"), "i").alias("p")).select(key, "p.period", "p.confidence")


def arc_curve(profile: DataFrame, key: str, position: str, m: int, chunk: int = CHUNK) -> DataFrame:
    """(key, position, crossing): arcs from windows to their neighbours that cross each place, over as many as chance would give, at most 1.

    Sums run within chunks of a series and over the sums of chunks. Places within
    a window of either end count as 1: few arcs can cross there.
    """
    steps = profile.select(key, F.explode(F.array(F.struct(F.least(position, "neighbour").alias("at"), F.lit(1).alias("step")), F.struct(F.greatest(position, "neighbour").alias("at"), F.lit(-1).alias("step")))).alias("s")).select(key, "s.*")
    places = profile.select(key, F.col(position).alias("at"), F.lit(0).alias("step")).unionByName(steps).groupBy(key, "at").agg(F.sum("step").alias("step"))
    places = places.withColumn("chunk", F.expr(f"at div {chunk}"))
    totals = places.groupBy(key, "chunk").agg(F.sum("step").alias("total"), F.count("*").alias("n"))
    over = Window.partitionBy(key)
    starts = totals.select(F.col(key).alias("its_key"), F.col("chunk").alias("its_chunk"), (F.sum("total").over(over.orderBy("chunk")) - F.col("total")).alias("before"), F.sum("n").over(over).alias("n"))
    joined = places.join(starts, F.col(key).eqNullSafe(F.col("its_key")) & (F.col("chunk") == F.col("its_chunk")))
    crossing = F.sum("step").over(Window.partitionBy(key, "chunk").orderBy("at")) + F.col("before")
    chance = 2 * F.col("at") * (F.col("n") - F.col("at")) / F.col("n")
    edge = (F.col("at") < m) | (F.col("at") >= F.col("n") - m)
    counted = joined.withColumn("arcs", crossing)
    return counted.select(key, F.col("at").alias(position), F.when(edge, 1.0).otherwise(F.least(F.round(F.col("arcs") / chance, 9), F.lit(1.0))).alias("crossing"))


def regime_changes(series: DataFrame, key: str, position: str, value: str, m: int, regimes: int = 5, chunk: int = CHUNK) -> DataFrame:
    """Places where a series changes its shape: rank, crossing, mean and deviation of the m values on either side.

    The regimes - 1 lowest places of the arc curve of the matrix profile, a window
    apart; places without any deficit of arcs, or with fewer than three values on
    a side, are none.
    """
    curve = arc_curve(matrix_profile(series, key, position, value, m, chunk), key, position, m, chunk)
    places = lowest(curve, key, position, "crossing", regimes - 1, m).where("crossing < 1")
    around = places.select("*", F.explode(F.sequence(F.col(position) - m, F.col(position) + m - 1)).alias("__at"))
    values = series.select(F.col(key).alias("__key"), F.col(position).cast("bigint").alias("__its"), F.col(value).cast("double").alias("__x"))
    both = around.join(values, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__at") == F.col("__its")))
    side = lambda before: F.when((F.col("__at") < F.col(position)) == F.lit(before), F.col("__x"))
    named: list[Column] = []
    for name, before in (("before", True), ("after", False)):
        named += [F.avg(side(before)).alias(f"mean_{name}"), F.stddev_pop(side(before)).alias(f"sd_{name}"), F.count(side(before)).alias(f"n_{name}")]
    return both.groupBy(key, position, "rank", "crossing").agg(*named).where("n_before >= 3 AND n_after >= 3").drop("n_before", "n_after").withColumn("magnitude", F.abs(F.col("mean_after") - F.col("mean_before")))
