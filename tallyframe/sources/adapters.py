"""The ledger, its relationships and the entity graph, as views of the driver's tables.

Only this module knows the driver's schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kind = F.col("o_orderstatus")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("event_id"),
        F.col("c_nationkey").cast("bigint").alias("user_id"),
        F.col("o_custkey").alias("file_id"),
        F.when(kind == "F", "invoice").when(kind == "O", "payment").otherwise("transfer").alias("document_type"),
        F.when(kind == "F", "revenue").when(kind == "O", "expense").otherwise("transfer").alias("category"),
        F.col("c_mktsegment").alias("source_platform"),
        F.col("c_name").alias("vendor_standard"),
        F.col("o_totalprice").cast("decimal(15,2)").alias("amount_usd"),
        F.col("o_orderdate").alias("source_ts"),
        F.col("o_orderpriority").alias("priority"),
        ((F.col("o_orderkey") % 100).cast("double") / 100).alias("confidence_score"),
    )


def relationships(ledger: DataFrame) -> DataFrame:
    """Each event to the next one of its file."""
    following = F.lead("event_id").over(Window.partitionBy("file_id").orderBy("source_ts", "event_id"))
    direction = F.create_map(*(F.lit(x) for kv in enumerate(["source_causes_target", "bidirectional", "correlation_only", "target_causes_source"]) for x in kv))
    return (
        ledger.select("*", following.alias("target_event_id"))
        .where("target_event_id IS NOT NULL")
        .select(
            F.col("event_id").alias("relationship_id"),
            "user_id",
            F.col("event_id").alias("source_event_id"),
            "target_event_id",
            F.concat("document_type", F.lit("_to_next")).alias("relationship_type"),
            (F.lit(0.5) + (F.col("event_id") % 50).cast("double") / 100).alias("confidence_score"),
            direction[(F.col("event_id") % 4).cast("int")].alias("temporal_causality"),
        )
    )


def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between nations: supplier to customer, one row per pair."""
    lines, orders, customers, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    # partial sums before the joins: lines meet orders once per (order, supplier)
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    parts = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"), F.sum(value).alias("w"))
    joined = parts.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("s_nationkey").cast("bigint").alias("src"), F.col("c_nationkey").cast("bigint").alias("dst")).agg(F.sum("n").alias("n_lines"), F.round(F.sum("w"), 2).alias("weight"))


# The same three views for DuckDB.
LEDGER_SQL = """
ledger_events AS (
 SELECT o.o_orderkey AS event_id, CAST(c.c_nationkey AS BIGINT) AS user_id, o.o_custkey AS file_id,
  CASE o.o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'payment' ELSE 'transfer' END AS document_type,
  CASE o.o_orderstatus WHEN 'F' THEN 'revenue' WHEN 'O' THEN 'expense' ELSE 'transfer' END AS category,
  c.c_mktsegment AS source_platform, c.c_name AS vendor_standard,
  CAST(o.o_totalprice AS DECIMAL(15,2)) AS amount_usd, o.o_orderdate AS source_ts, o.o_orderpriority AS priority,
  CAST(o.o_orderkey % 100 AS DOUBLE)/100 AS confidence_score
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""
RELATIONSHIPS_SQL = LEDGER_SQL + """,
relationships AS (
 SELECT event_id AS relationship_id, user_id, event_id AS source_event_id, nxt AS target_event_id,
  concat(document_type,'_to_next') AS relationship_type, 0.5 + CAST(event_id % 50 AS DOUBLE)/100 AS confidence_score,
  CASE event_id % 4 WHEN 0 THEN 'source_causes_target' WHEN 1 THEN 'bidirectional' WHEN 2 THEN 'correlation_only' ELSE 'target_causes_source' END AS temporal_causality
 FROM (SELECT l.*, lead(event_id) OVER (PARTITION BY file_id ORDER BY source_ts, event_id) AS nxt FROM ledger_events l) t WHERE nxt IS NOT NULL)"""
EDGES_SQL = """
entity_edges AS (
 SELECT CAST(s.s_nationkey AS BIGINT) AS src, CAST(c.c_nationkey AS BIGINT) AS dst, count(*) AS n_lines,
  round(sum(l.l_extendedprice*(1-l.l_discount)),2) AS weight
 FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN customer c ON o.o_custkey=c.c_custkey JOIN supplier s ON l.l_suppkey=s.s_suppkey GROUP BY 1,2)"""
