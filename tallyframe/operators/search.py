"""Filtered search, top-k, pages, reviews, keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import cosine


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, **equals) -> DataFrame:
    """One page of the rows that equal the given values, with the count of all of them. order must be total."""
    for column, value in equals.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    total = df.agg(F.count("*").alias("total_count"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def review_queue(ledger: DataFrame, limit: int) -> DataFrame:
    rank = F.when(F.col("confidence_score") < 0.3, 0).when(F.col("confidence_score") < 0.5, 1).otherwise(2)
    return ledger.where(F.col("confidence_score") < 0.7).select("event_id", "document_type", rank.alias("priority_rank")).orderBy("priority_rank", "event_id").limit(limit)


def latest_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Brute-force cosine top-k; TakeOrdered keeps k rows per partition."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(cosine(F.col(vector), q), 9).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def nearest_to(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """nearest() to the vector of `query`, a table of one row, which is broadcast."""
    joined = vectors.join(F.broadcast(query.select(F.col(vector).alias("__q"))))
    return joined.select(key, F.round(cosine(F.col(vector), F.col("__q")), 9).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def merge_mappings(held: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert of (user_id, source, target, confidence, usage): confidences averaged, usages added; nulls in keys match nulls."""
    a, b = held.alias("a"), seen.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("user_id", "source", "target")]
    both = F.col("a.usage").isNotNull() & F.col("b.usage").isNotNull()
    return a.join(b, same, "full").select(
        *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("user_id", "source", "target")),
        F.when(both, (F.col("a.confidence") + F.col("b.confidence")) / 2).otherwise(F.coalesce("a.confidence", "b.confidence")).alias("confidence"),
        (F.coalesce("a.usage", F.lit(0)) + F.coalesce("b.usage", F.lit(0))).alias("usage"),
    )
