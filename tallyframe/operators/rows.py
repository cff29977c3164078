"""Sheet anomalies, decisions on duplicate files, corrections of resolved entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import CELL_ERRORS


def sheet_anomalies(cells: DataFrame, key: str, amounts: list[str]) -> DataFrame:
    """Per sheet: cells with an error code, missing values, repeated rows, negative values in the named amount columns.

    Equal rows are counted first, so a repeated row is looked at once and only counts meet in a sheet's group.
    """
    columns = [c for c in cells.columns if c != key]
    texts = [c for c, t in cells.dtypes if t == "string" and c != key]
    total = lambda flags: sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0)) * F.col("__n")
    broken: list[Column] = [F.greatest(*(F.col(c).contains(e) for e in CELL_ERRORS)) for c in texts]
    rows = cells.groupBy(key, *columns).agg(F.count("*").alias("__n"))
    sums = {"corrupted_cells": total(broken), "missing_values": total(F.col(c).isNull() for c in columns), "duplicate_rows": F.col("__n") - 1, "negative_amounts": total(F.col(c) < 0 for c in amounts)}
    return rows.groupBy(key).agg(*(F.sum(v).alias(name) for name, v in sums.items()))


def decided(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """files (file_id, user_id, file_hash, status) after decisions (file_id, user_id, file_hash, decision): `replace` marks all other files of the user and hash as replaced; the rest changes nothing.

    If several files replace under one hash, each is marked by the others.
    """
    replacing = decisions.where("decision = 'replace'").groupBy("user_id", "file_hash").agg(F.min("file_id").alias("__first"), F.max("file_id").alias("__last"))
    hit = F.col("__first").isNotNull() & ((F.col("file_id") != F.col("__first")) | (F.col("file_id") != F.col("__last")))
    return files.join(replacing, ["user_id", "file_hash"], "left").withColumn("status", F.when(hit, "replaced").otherwise(F.col("status"))).drop("__first", "__last")


def corrected_entities(entities: DataFrame, corrections: DataFrame, gain: float = 0.05) -> DataFrame:
    """entities (entity_id, confidence_score) after corrections (correct_entity_id): each adds gain, up to 1."""
    n = corrections.groupBy(F.col("correct_entity_id").alias("entity_id")).agg(F.count("*").alias("__n"))
    more = F.least(F.col("confidence_score") + F.col("__n") * gain, F.lit(1.0))
    return entities.join(n, "entity_id", "left").withColumn("confidence_score", F.coalesce(more, "confidence_score")).withColumn("corrections", F.coalesce("__n", F.lit(0))).drop("__n")
