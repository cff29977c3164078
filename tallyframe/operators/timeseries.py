"""Gaps, motifs, seasons and regime shifts of many series at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_series(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, day, value): daily sums with empty days filled by 0."""
    summed = events.groupBy(key, F.to_date(ts).alias("day")).agg(F.sum(value).cast("double").alias("value"))
    span = summed.groupBy(key).agg(F.min("day").alias("a"), F.max("day").alias("b")).select(key, F.explode(F.sequence("a", "b")).alias("day"))
    return span.join(summed, [key, "day"], "left").select(key, "day", F.coalesce("value", F.lit(0.0)).alias("value"))


def rolling_shifts(series: DataFrame, key: str, order: str, value: str, width: int, k: float) -> DataFrame:
    """Points where the mean of the next `width` values is more than k standard deviations from that of the last ones."""
    ordered = Window.partitionBy(key).orderBy(order)
    before, after = ordered.rowsBetween(-width, -1), ordered.rowsBetween(0, width - 1)
    x = series.select(key, order, F.avg(value).over(before).alias("before"), F.stddev_samp(value).over(before).alias("sd"), F.avg(value).over(after).alias("after"), F.count(value).over(before).alias("n"), F.count(value).over(after).alias("m"))
    return x.where((F.col("n") == width) & (F.col("m") == width) & (F.col("sd") > 0) & (F.abs(F.col("after") - F.col("before")) > k * F.col("sd"))).select(key, order, "before", "after")


def seasons(series: DataFrame, key: str, order: str, value: str, periods: tuple[int, ...] = (7, 14, 30), least: float = 0.3) -> DataFrame:
    """(key, period, strength): the first period whose seasonal means vary by more than `least` of the rest.

    A series is one key's days, so a group is bounded by the length of the calendar.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        x = frame[value].to_numpy(dtype=float)
        for p in periods:
            if len(x) < 2 * p:
                continue
            trend = np.convolve(np.pad(x, (p // 2, p - 1 - p // 2), mode="edge"), np.ones(p) / p, mode="valid")
            flat = x - trend
            mean = np.array([flat[i::p].mean() for i in range(p)])
            rest = flat - np.resize(mean, len(flat))
            if (spread := rest.std()) > 0 and mean.std() / spread > least:
                return pd.DataFrame({key: [frame[key].iloc[0]], "period": [p], "strength": [mean.std() / spread]})
        return pd.DataFrame({key: [], "period": [], "strength": []}).astype({key: frame[key].dtype})

    return series.groupBy(key).applyInPandas(one, f"{key} {series.schema[key].dataType.simpleString()}, period int, strength double")


def motifs(series: DataFrame, key: str, order: str, value: str, pattern: list[float], tolerance: float) -> DataFrame:
    """Starts of runs whose shape, with mean and scale removed, is within tolerance of the pattern."""
    m = len(pattern)
    shape = np.array(pattern, dtype=float)
    shape = (shape - shape.mean()) / (shape.std() or 1.0)
    ordered = Window.partitionBy(key).orderBy(order).rowsBetween(0, m - 1)
    runs = series.select(key, order, F.collect_list(F.col(value).cast("double")).over(ordered).alias("run")).where(F.size("run") == m)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["run"].to_numpy())
                x = x - x.mean(axis=1, keepdims=True)
                sd = x.std(axis=1, keepdims=True)
                distance = np.sqrt((((x / np.where(sd == 0, 1, sd)) - shape) ** 2).sum(axis=1))
                hit = distance < tolerance * np.sqrt(m)
                yield frame.loc[hit, [key, order]].assign(distance=distance[hit])

    schema = series.select(key, order).schema.simpleString()[7:-1].replace(":", " ")
    return runs.mapInPandas(near, f"{schema}, distance double")
