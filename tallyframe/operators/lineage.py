"""Row lineage as an array of steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def step(name: str, at: Column, **details: Column) -> Column:
    return F.struct(F.lit(name).alias("step"), at.alias("at"), F.to_json(F.struct(*(v.alias(k) for k, v in details.items()))).alias("details"))


def append_step(path: Column, new: Column) -> Column:
    return F.when(path.isNull(), F.array(new)).otherwise(F.concat(path, F.array(new)))


def show(path: Column) -> Column:
    """Numbered steps in one line."""
    return F.array_join(F.transform(path, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["step"])), " ")


def integrity(stored: Column, computed: Column) -> Column:
    return F.when(stored.isNull(), "missing").when(stored == computed, "valid").otherwise("tampered")
