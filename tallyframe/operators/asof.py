"""The latest value at or before each row's moment, for keys that may hold most of the rows.

Rows and values are one sorted table, dealt by ranges of key and moment, so that
a key spans as many tasks as it has room for. Each task carries the last value
of a key forward over its own rows; what it starts with comes from a small
table of the last values of all tasks, one row for each task and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage_cut import written


def asof_join(rows: DataFrame, values: DataFrame, key: str, at: str, value: str, values_key: str | None = None, values_at: str | None = None, out: str = "value", out_at: str = "value_at", parts: int | None = None) -> DataFrame:
    """rows with `out`, the value of the key's latest moment at or before the row's, and `out_at`, that moment; both null if there is none.

    Of several values of a key and moment the largest counts; null values count
    as absent. Rows whose key or moment is null get none. Other columns are kept.
    """
    kept = [c for c in rows.columns if c not in (out, out_at)]
    moment = rows.schema[at].dataType
    given = values.select(F.col(values_key or key).alias("__key"), F.col(values_at or at).cast(moment).alias("__at"), F.struct(F.col(values_at or at).cast(moment).alias("at"), F.col(value).alias("value")).alias("__given"))
    given = given.where("__key IS NOT NULL AND __at IS NOT NULL AND __given.value IS NOT NULL").groupBy("__key", "__at").agg(F.max("__given").alias("__given"))
    asked = rows.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.struct(*(F.col(c) for c in kept)).alias("__row"))
    kind = asked.schema["__row"].dataType
    whole = asked.withColumns({"__given": F.lit(None).cast(given.schema["__given"].dataType), "__asks": F.lit(1)}).unionByName(given.withColumns({"__row": F.lit(None).cast(kind), "__asks": F.lit(0)}))
    # values stand before the rows of their moment; the hash spreads rows that agree in key and moment (maps cannot be hashed)
    told = [F.col("__row")[c] for c in kept if "map<" not in rows.schema[c].dataType.simpleString()]
    order = [F.col("__key"), F.col("__at"), F.col("__asks"), F.xxhash64(*told) if told else F.lit(0)]
    dealt = whole.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("__place", F.monotonically_increasing_id()), "dealt").withColumn("__task", F.shiftright("__place", 33))
    ends = dealt.where("__asks = 0").groupBy("__key", "__task").agg(F.max_by("__given", "__place").alias("last"))
    tasks = dealt.groupBy("__key", "__task").agg(F.count("*").alias("n")).where("__key IS NOT NULL").join(ends, ["__key", "__task"], "left")
    before = Window.partitionBy("__key").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task at most
    starts = written(tasks.select(F.col("__key").alias("__its_key"), F.col("__task").alias("__its_task"), F.last("last", ignorenulls=True).over(before).alias("__start")), "starts")
    inside = Window.partitionBy("__task", "__key").orderBy("__place")
    carried = dealt.withColumn("__found", F.last("__given", ignorenulls=True).over(inside)).where("__asks = 1")
    found = carried.join(starts, (F.col("__task") == F.col("__its_task")) & (F.col("__key") == F.col("__its_key")), "left")
    best = F.when(F.col("__at").isNotNull() & F.col("__key").isNotNull(), F.coalesce("__found", "__start"))
    return found.select(*(F.col("__row")[c].alias(c) for c in kept), best["value"].alias(out), best["at"].alias(out_at))
