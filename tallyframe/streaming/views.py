"""Joined and aggregated views kept as tables and mended by streams of changed keys.

A view is stored as batches: each holds, for the ids it touches, all rows of the
view that have this id (none, if it is gone). The newest batch of an id counts.
A batch is written to a folder of its own, so writing it again replaces it: a
stream that repeats a batch after a failure leaves the view as it should be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..operators.lineage_cut import written

Tables = dict[str, DataFrame]
#: Between the parts of a key.
SEPARATOR = "\x1f"


class BatchTable:
    """Rows by id, in batches, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, batch: int, ids: DataFrame, rows: DataFrame) -> None:
        """The rows of these ids from this batch on. rows: id and the view's other columns; only those of `ids` may be there."""
        others = [c for c in rows.columns if c != "id"]
        held = rows.groupBy("id").agg(F.collect_list(F.struct(*others)).alias("rows"))
        whole = ids.select("id").distinct().join(held, "id", "left")
        whole.withColumn("rows", F.coalesce("rows", F.array().cast(held.schema["rows"].dataType))).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def current(self, like: StructType) -> DataFrame:
        """The view; `like`: its columns, id first."""
        rows = ArrayType(StructType([StructField(f.name, f.dataType) for f in like.fields if f.name != "id"]))
        kind = StructType([StructField("id", like["id"].dataType), StructField("rows", rows), StructField("batch", LongType())])
        held = self.spark.read.schema(kind).parquet(self.folder)
        newest = held.groupBy("id").agg(F.max_by("rows", "batch").alias("rows"))
        return newest.select("id", F.inline("rows"))

    def compact(self, folder: str, like: StructType) -> BatchTable:
        """A copy with the present rows as its batch 0."""
        other, rows = BatchTable(self.spark, folder), self.current(like)
        other.write(0, rows.select("id"), rows)
        return other


def key(*columns: Column | str) -> Column:
    return F.concat_ws(SEPARATOR, *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns))


#: What a relationship and a row of each table are joined on, beside the user.
JOINED_ON = {
    "causal": (["id"], ["relationship_id"]),
    "temporal": (["relationship_type"], ["relationship_type"]),
    "patterns": (["pattern_id"], ["id"]),
    "cross_platform": (["source_event_id", "target_event_id"], ["source_event_id", "target_event_id"]),
    "predicted": (["source_event_id"], ["source_event_id"]),
    "causes": (["source_event_id"], ["problem_event_id"]),
}


def enriched(tables: Tables) -> DataFrame:
    """Relationships with what the six other tables know of them: left joins on user and key, several matches give several rows."""
    out = tables["relationships"].select("*", F.col("confidence_score").alias("score")).drop("confidence_score")
    wanted = {
        "causal": {"causal_strength": F.col("causal_score"), "causal_direction": F.col("causal_direction")},
        "temporal": {
            "temporal_pattern_id": F.col("id"),
            "recurrence_score": F.col("confidence_score"),
            "recurrence_frequency": F.concat(F.lit("Every "), F.col("avg_days_between").cast("string"), F.lit(" days")),
            "seasonal_pattern_id": F.col("seasonal_period_days"),
            "seasonal_strength": F.col("seasonal_amplitude"),
        },
        "patterns": {"pattern_id_enriched": F.col("id"), "pattern_name": F.col("relationship_type")},
        "cross_platform": {"cross_platform_id": F.col("id"), "platform_sources": F.col("source_platform")},
        "predicted": {"predicted_relationship_id": F.col("id"), "prediction_confidence": F.col("confidence_score"), "prediction_reason": F.col("prediction_reasoning")},
        "causes": {"root_cause_id": F.col("id"), "root_cause_analysis": F.col("root_cause_description")},
    }
    without = {"causal_strength": 0.0, "causal_direction": "none", "recurrence_score": 0.0, "recurrence_frequency": "none", "seasonal_pattern_id": 0, "seasonal_strength": 0.0, "pattern_name": "", "platform_sources": "", "prediction_confidence": 0.0, "prediction_reason": "", "root_cause_analysis": ""}
    for name, columns in wanted.items():
        ours, theirs = JOINED_ON[name]
        held = tables[name].where(F.col("status").isin("pending", "fulfilled")) if name == "predicted" else tables[name]
        held = held.select(F.col("user_id").alias("__user"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(theirs)), *(c.alias(n) for n, c in columns.items()))
        same = F.col("user_id") == F.col("__user")
        for i, c in enumerate(ours):
            same = same & (F.col(c) == F.col(f"__{i}"))
        out = out.join(held, same, "left").drop("__user", *(f"__{i}" for i in range(len(theirs))))
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in without.items()}).withColumnRenamed("score", "confidence_score")


def changed_keys(name: str, rows: DataFrame) -> DataFrame:
    """(name, user_id, key) that tell of changed, added or removed rows of a table; "relationships" or a name of JOINED_ON."""
    return rows.select(F.lit(name).alias("name"), F.col("user_id").cast("bigint").alias("user_id"), key(*(["id"] if name == "relationships" else JOINED_ON[name][1])).alias("key")).distinct()


class EnrichedView:
    """The enriched relationships as a table. `tables` gives the source tables as they are when it is called."""

    def __init__(self, spark: SparkSession, folder: str, tables: Callable[[], Tables]):
        self.table, self.tables = BatchTable(spark, folder), tables

    def build(self) -> None:
        """The whole view as batch 0."""
        tables = self.tables()
        self.table.write(0, tables["relationships"], enriched(tables))

    def merge(self, changes: DataFrame, batch: int) -> None:
        """Makes the rows anew whose relationship, or whose match in another table, is among the changed keys."""
        tables = self.tables()
        links = tables["relationships"]
        own = [F.struct(F.lit("relationships").alias("name"), key("id").alias("key"))] + [F.struct(F.lit(name).alias("name"), key(*ours).alias("key")) for name, (ours, _) in JOINED_ON.items()]
        told = changes.select("name", "user_id", "key").distinct()
        met = links.select("id", "user_id", F.explode(F.array(*own)).alias("k")).select("id", "user_id", "k.*").join(told, ["name", "user_id", "key"], "left_semi")
        gone = told.where("name = 'relationships'").select(F.col("key").cast(links.schema["id"].dataType).alias("id"))
        ids = written(met.select("id").unionByName(gone).distinct(), "ids")
        self.table.write(batch, ids, enriched(tables | {"relationships": links.join(ids, "id", "left_semi")}))

    def follow(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Merges a stream of changed keys; batch 0 of the stream is batch 1 of the view."""
        return changes.writeStream.foreachBatch(lambda df, i: self.merge(df, i + 1)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def current(self) -> DataFrame:
        return self.table.current(enriched(self.tables()).schema)


class MetricsView:
    """Any aggregate by user as a table, made anew only for users with changes."""

    def __init__(self, spark: SparkSession, folder: str, source: Callable[[], DataFrame], metrics: Callable[[DataFrame], DataFrame], user: str = "user_id"):
        self.table, self.source, self.metrics, self.user = BatchTable(spark, folder), source, metrics, user

    def _made(self, rows: DataFrame) -> DataFrame:
        return self.metrics(rows).withColumnRenamed(self.user, "id")

    def refresh(self, batch: int = 0, users: DataFrame | None = None) -> None:
        """All users, or only the given ones; a user without rows any more goes."""
        rows = self.source()
        ids = (rows if users is None else users).select(F.col(self.user).alias("id")).distinct()
        kept = rows if users is None else rows.join(users.select(self.user).distinct(), self.user, "left_semi")
        self.table.write(batch, ids, self._made(kept))

    def current(self) -> DataFrame:
        return self.table.current(self._made(self.source()).schema).withColumnRenamed("id", self.user)
