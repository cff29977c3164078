"""Reading uploads of several formats, with quarantine of bad rows; content-addressed and batch-stamped sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Tokens that stand for a missing value.
NULL_TOKENS = ["", "N/A", "NULL", "null", "nan", "NaN"]


def nulls_for_tokens(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(F.trim(F.col(f"`{c}`")).isin(NULL_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows); a row is bad if it does not fit the schema. Without a schema all columns are strings."""
    if schema is None:
        return nulls_for_tokens(spark.read.csv(path, header=True)), spark.createDataFrame([], "_corrupt_record string")
    whole = StructType(schema.fields).add("_corrupt_record", "string")
    rows = spark.read.csv(path, header=True, schema=whole, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return nulls_for_tokens(rows.where("_corrupt_record IS NULL").drop("_corrupt_record")), rows.where("_corrupt_record IS NOT NULL").select("_corrupt_record")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By extension: CSV, JSON lines, Parquet, text."""
    kind = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    readers = {"csv": lambda: read_csv(spark, path)[0], "json": lambda: spark.read.json(path), "parquet": lambda: spark.read.parquet(path), "txt": lambda: spark.read.text(path)}
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    return readers[kind]().withColumn("source_file", F.col("_metadata.file_path"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, kind) of each file, kind by its first bytes."""
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head == "504B0304", "xlsx").when(head == "D0CF11E0", "xls").when(head == "50415231", "parquet").otherwise("text")
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), kind.alias("kind"))


def quarantine(df: DataFrame, checks: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all SQL conditions, and the others with the names of what failed."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(c), F.lit(False)), name) for name, c in checks.items())))
    judged = df.withColumn("failed_checks", failed)
    return judged.where(F.size("failed_checks") == 0).drop("failed_checks"), judged.where(F.size("failed_checks") > 0)


def write_batch(df: DataFrame, path: str, batch_id: str) -> None:
    """Append-safe: a batch written again replaces itself."""
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
