"""Checks of single records: hashes, platform ids, rate limits, lineage steps, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an id of a platform looks like, and the platform's name in messages.
PLATFORM_IDS = {
    "quickbooks": ("QuickBooks", r"^(?:TXN-?|INV-?|VEN-?|CUST-?|BILL-?|PAY-?|ACC-?|CLASS-?|ITEM-?|JE-?)?\d{1,8}$"),
    "stripe": ("Stripe", r"^(ch_|pi_|cus_|in_)[a-zA-Z0-9]{14,24}$"),
    "razorpay": ("Razorpay", r"^(pay_|order_|rfnd_|setl_)[a-zA-Z0-9]{14}$"),
}


def provenance_hash(file: Column, row: Column, payload: Column) -> Column:
    """SHA-256 of file, row number and payload text; a missing payload is the empty object."""
    return F.sha2(F.concat_ws("||", F.coalesce(file, F.lit("")), F.coalesce(row.cast("string"), F.lit("")), F.coalesce(payload, F.lit("{}"))), 256)


def platform_id_verdict(value: Column, platform: Column) -> Column:
    """struct(is_valid, reason, validation_method): empty, then length, then the platform's pattern."""
    v = F.trim(value)
    verdict = lambda ok, reason, method: F.struct(F.lit(ok).alias("is_valid"), reason.alias("reason"), F.lit(method).alias("validation_method"))
    out = verdict(True, F.lit("Valid ID format"), "format_check")
    for name, (shown, pattern) in PLATFORM_IDS.items():
        out = F.when((platform == name) & ~v.rlike(pattern), verdict(False, F.lit(f"Invalid {shown} ID format"), "platform_specific")).otherwise(out)
    too_long = verdict(False, F.concat(F.lit("ID length invalid: "), F.length(v).cast("string"), F.lit(" (must be 1-50 characters)")), "length_check")
    return F.when(v.isNull() | (v == ""), verdict(False, F.lit("Empty or null ID value"), "basic_check")).when(F.length(v) > 50, too_long).otherwise(out)


def known_hashes(asked: DataFrame, held: DataFrame) -> DataFrame:
    """asked (user_id, file_hash) with `known`: whether held has the hash for the user."""
    seen = held.select("user_id", "file_hash").distinct().withColumn("known", F.lit(True))
    return asked.join(seen, ["user_id", "file_hash"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def dispatches_within_limit(dispatches: DataFrame, failures: DataFrame, most: int = 5) -> DataFrame:
    """Per provider and minute: dispatches, failures, and whether another dispatch may go; each failure lowers the limit by one, to one at least.

    dispatches, failures: (provider, ts).
    """
    minute = F.date_trunc("minute", "ts").alias("minute")
    sent = dispatches.groupBy("provider", minute).agg(F.count("*").alias("sent"))
    failed = failures.groupBy("provider", minute).agg(F.count("*").alias("failed"))
    joined = sent.join(failed, ["provider", "minute"], "left").withColumn("failed", F.coalesce("failed", F.lit(0)))
    limit = F.greatest(F.lit(1), most - F.col("failed"))
    return joined.withColumn("limit", limit).withColumn("allowed", F.col("sent") < limit)


def lineage_steps(events: DataFrame) -> DataFrame:
    """(event_id, step_number from 1, step_name, operation) of `lineage_path`, a JSON list of steps."""
    steps = F.from_json("lineage_path", "array<struct<step:string,operation:string>>")
    return events.select("event_id", F.posexplode(steps).alias("at", "s")).select("event_id", (F.col("at") + 1).alias("step_number"), F.col("s.step").alias("step_name"), F.col("s.operation").alias("operation"))


def without_orphans(events: DataFrame, files: DataFrame, as_of: Column, older_than_hours: int = 24) -> DataFrame:
    """events (file_id, created_at) but for those whose file is gone and that are older than so many hours."""
    old = F.col("created_at").cast("timestamp") < as_of - F.make_dt_interval(hours=F.lit(older_than_hours))
    here = files.select("file_id").distinct().withColumn("__here", F.lit(True))
    return events.join(here, "file_id", "left").where(F.coalesce("__here", F.lit(False)) | ~old).drop("__here")
