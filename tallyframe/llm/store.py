"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of an id list up to which it is broadcast (about 64 MB); a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session that names none gets a temporary one; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    fallback = tempfile.mkdtemp(prefix="tallyframe-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


class Tables:
    """Intermediate tables of one call, in a folder of their own.

    Writing a table as Parquet and reading it back cuts the lineage, so a lost
    executor repeats only what reads the table. A table that no later step reads
    is dropped at once; those that a returned DataFrame reads stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark)}/tallyframe-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}-{name}"
        schema = df.schema
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[name])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.spark._jvm.System.gc()  # lets Spark's cleaner remove shuffle files that no plan holds any more


def materialise(df: DataFrame, name: str) -> DataFrame:
    """One table written and read back."""
    return Tables(df.sparkSession).write(df, name)


def without(docs: DataFrame, gone: DataFrame, condition) -> DataFrame:
    """Rows of docs for which no row of `gone`, a written table of ids, meets the condition.

    A short list is broadcast, so that texts stay where they are.
    """
    return docs.join(gone.hint("broadcast") if gone.count() <= BROADCAST_ROWS else gone, condition, "left_anti")
