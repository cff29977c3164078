"""Aggregates over the ledger: cash flow, quality, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import transaction_semantics

def _signed() -> Column:
    return F.when(F.col("category") == "revenue", F.col("amount_usd")).when(F.col("category") == "expense", -F.col("amount_usd")).otherwise(F.lit(0).cast("decimal(15,2)"))


def monthly_cash_flow(ledger: DataFrame) -> DataFrame:
    month = F.date_format(F.trunc("source_ts", "month"), "yyyy-MM-dd").alias("month")
    amount = F.col("amount_usd")
    return ledger.groupBy("user_id", month).agg(
        F.sum(F.when(F.col("category") == "revenue", amount).otherwise(0)).cast("double").alias("income"),
        F.sum(F.when(F.col("category") == "expense", amount).otherwise(0)).cast("double").alias("expense"),
        F.sum(_signed()).cast("double").alias("net"),
        F.count("*").alias("n_events"),
    )


def runway_forecast(ledger: DataFrame, as_of: Column, months: int = 6) -> DataFrame:
    """Per user: balance to date, mean monthly burn of the last months, and how many months it lasts (999.99: no burn)."""
    first = F.add_months(F.trunc(as_of, "month"), -months)
    known = ledger.where(F.col("source_ts") <= as_of)
    monthly = known.groupBy("user_id", F.trunc("source_ts", "month").alias("m")).agg(
        F.sum(_signed()).alias("net"), F.sum(F.when(F.col("category") == "revenue", F.col("amount_usd")).otherwise(0)).alias("i"), F.sum(F.when(F.col("category") == "expense", F.col("amount_usd")).otherwise(0)).alias("e")
    )
    recent = F.col("m") >= first
    out = monthly.groupBy("user_id").agg(
        F.sum("net").cast("double").alias("balance"), (F.sum(F.when(recent, F.col("e")).otherwise(0)).cast("double") / months).alias("e"), (F.sum(F.when(recent, F.col("i")).otherwise(0)).cast("double") / months).alias("i")
    )
    burn = F.col("e") - F.col("i")
    return out.select("user_id", F.round("balance", 2).alias("balance"), F.round(burn, 2).alias("monthly_burn"), F.round(F.when(burn > 0, F.col("balance") / burn).otherwise(999.99), 2).alias("runway_months"))


def document_type_stats(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("document_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence_score"), 4).alias("avg_confidence"), F.sum("amount_usd").cast("double").alias("total"), F.countDistinct("source_platform").alias("platforms"))


def accuracy_stats(ledger: DataFrame) -> DataFrame:
    s = transaction_semantics(F.col("category"), F.col("amount_usd"))
    low = F.col("confidence_score") < 0.7
    return ledger.select("user_id", "confidence_score", s.alias("s")).groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("s.direction") == "credit").alias("inflows"),
        F.count_if(F.col("s.direction") == "debit").alias("outflows"),
        F.count_if("s.affects_cash").alias("cash_events"),
        F.count_if(low).alias("for_review"),
        F.count_if(F.col("confidence_score") < 0.5).alias("high_priority"),
        F.abs(F.sum("s.amount_signed")).cast("double").alias("abs_net"),
    )


def dashboard_metrics(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("user_id").agg(
        F.count("*").alias("events"),
        F.countDistinct("source_platform").alias("platforms"),
        F.countDistinct(F.to_date("source_ts")).alias("active_days"),
        F.countDistinct("file_id").alias("files"),
        F.date_format(F.max("source_ts"), "yyyy-MM-dd").alias("last_day"),
        F.round(F.avg("confidence_score"), 6).alias("avg_confidence"),
    )


def category_map(ledger: DataFrame) -> DataFrame:
    """Per user a sorted text of category counts."""
    counts = ledger.groupBy("user_id", "category").agg(F.count("*").alias("n"))
    pair = F.concat("category", F.lit(":"), F.col("n").cast("string"))
    return counts.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("categories"))


def currency_summary(ledger: DataFrame, rates: DataFrame) -> DataFrame:
    """rates: (source_platform, currency, rate), small by construction: one row per platform."""
    return ledger.join(F.broadcast(rates), "source_platform").groupBy("currency").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("amount_usd").cast("double") * F.col("rate")), 0).alias("total_usd"), F.round(F.avg("rate"), 4).alias("avg_rate")
    )


def system_health(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def key_stats(events: DataFrame, json: str, value: Column) -> DataFrame:
    """Per key of a JSON object: rows, distinct values, mean of value."""
    pairs = events.select(F.explode(F.from_json(F.col(json), "map<string,string>")).alias("key", "v"), value.alias("x"))
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("v").alias("distinct_values"), F.round(F.avg("x"), 6).alias("avg_value"))
