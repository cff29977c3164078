"""Gapless numbers within groups that may be far larger than one task should sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Tables


def numbered(rows: DataFrame, group: list[str], order: list[str], tables: Tables, name: str, number: str, total: str | None = None, parts: int | None = None) -> DataFrame:
    """rows with `number`: 0, 1, 2 and so on within each group, in the order; `total`: the rows of the group.

    Rows are dealt by ranges of group and order together, so that a group spans as
    many tasks as it has room for, then counted by task; each task's share of a
    group starts after the shares before it. `order` should tell all rows apart,
    else rows that agree stay in one task. `rows` is read twice and should be a
    written table. `parts`: the number of ranges, by default the session's.
    """
    placed = rows.repartitionByRange(*([parts] if parts else []), *(f"`{c}`" for c in [*group, *order])).sortWithinPartitions(*(f"`{c}`" for c in [*group, *order]))
    placed = tables.write(placed.withColumn("__at", F.monotonically_increasing_id()), f"{name}_sorted").withColumn("__task", F.shiftright("__at", 33))
    own = [F.col(f"`{g}`").alias(f"__its_{i}") for i, g in enumerate(group)]
    counts = placed.groupBy(F.col("__task").alias("__its_task"), *own).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    whole = Window.partitionBy(*(f"__its_{i}" for i in range(len(group))))
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__its_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = [F.sum("__rows").over(whole).alias("__total")] if total else []
    starts = tables.write(counts.select("__its_task", *(f"__its_{i}" for i in range(len(group))), (before - F.col("__first")).alias("__shift"), *sums), f"{name}_starts")
    same = F.col("__task") == F.col("__its_task")
    for i, g in enumerate(group):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"__its_{i}"))
    made = {number: (F.col("__at") + F.col("__shift")).cast("bigint")} | ({total: F.col("__total")} if total else {})
    return placed.join(starts, same).withColumns(made).drop("__at", "__task", "__its_task", "__shift", "__total", *(f"__its_{i}" for i in range(len(group))))
