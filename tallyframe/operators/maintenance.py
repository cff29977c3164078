"""Consistency checks and clean-ups as anti joins and filters; each returns what stays or what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(events: DataFrame, parents: list[tuple[DataFrame, str, str]], older_than: Column | None = None, ts: str = "source_ts") -> DataFrame:
    """Events whose parent row is missing in any of (parents, event key, parent key), each with the first reason."""
    out, reasons = events, []
    for i, (parent, key, parent_key) in enumerate(parents):
        present = parent.select(F.col(parent_key).alias(f"__k{i}")).distinct()
        out = out.join(present, F.col(key) == F.col(f"__k{i}"), "left")
        reasons.append(F.when(F.col(f"__k{i}").isNull(), f"no_{parent_key}"))
    wrong = out.withColumn("reason", F.coalesce(*reasons)).where("reason IS NOT NULL").drop(*(f"__k{i}" for i in range(len(parents))))
    return wrong if older_than is None else wrong.where(F.col(ts) < older_than)


def unexpired(rows: DataFrame, expires: str, as_of: Column) -> DataFrame:
    return rows.where(F.col(expires).isNull() | (F.col(expires) >= as_of))


def expire_stale(jobs: DataFrame, status: str, started: str, as_of: Column, hours: int) -> DataFrame:
    """Jobs that have run longer than the limit become failed."""
    stale = (F.col(status) == "running") & (F.col(started) < as_of - F.make_dt_interval(hours=F.lit(hours)))
    return jobs.withColumn(status, F.when(stale, "failed").otherwise(F.col(status)))


def rollback_ids(tables: dict[str, DataFrame], key: str, transaction: str) -> DataFrame:
    """(source, key): what each table wrote in a transaction; one row per id, so nothing is gathered."""
    out = None
    for name, df in tables.items():
        one = df.where(F.col("transaction_id") == transaction).select(F.lit(name).alias("source"), F.col(key).cast("string").alias(key))
        out = one if out is None else out.unionByName(one)
    return out


def fold_latest(base: DataFrame, extra: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """base with the columns of its latest extra row."""
    latest = extra.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("x")).select(key, "x.*")
    return base.join(latest, key, "left")
