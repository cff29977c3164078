"""Raw rows to enriched ones, as a chain of transforms on whole tables.

    rows.transform(with_core_fields, "row").transform(with_standards).transform(with_dollars, rates).transform(checked)

A row is a map of field names to texts, whatever its file calls its fields.
Everything but the likeness of vendor names is column arithmetic; dated rates
come by the as-of join of distinct currencies and days, so no task holds all
rows of a currency.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, fields
from ..functions.rules import CURRENCIES
from .asof import asof_join
from .lineage_cut import written

#: Forms of dates that are read, in this order; longer ones before their beginnings.
DATE_FORMS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "dd.MM.yyyy", "dd MMM yyyy", "MMM dd, yyyy", "yyyyMMdd"]


def with_core_fields(rows: DataFrame, row: str, today: date | None = None, least: float = 0.5) -> DataFrame:
    """rows with struct `core`: amount, vendor_name, date, description, currency, confidence, fields_extracted and detected (all analysed fields).

    Of several fields of one meaning the last one of confidence `least` or more
    counts. Without one: amount 0, no vendor, `today`, no description, USD.
    """
    held = rows.withColumn("__fields", fields.detected_fields(F.col(row))).withColumn("__kept", F.filter("__fields", lambda f: f["confidence"] >= least))

    def value(kind: str) -> Column:
        # a map keeps one value for a name, so the name leads to it
        named = F.element_at(F.filter("__kept", lambda f: f["type"].contains(kind)), -1)["name"]
        return F.when(F.exists("__kept", lambda f: f["type"].contains(kind)), F.col(row)[named])

    day = F.lit(today) if today else F.current_date()
    counted = F.size(F.filter("__kept", lambda f: f["type"].rlike("amount|vendor|date|description|currency")))
    core = F.struct(
        (F.coalesce(cleaning.parse_amount(value("amount")), F.lit(0.0)) + 0.0).alias("amount"),  # no negative zero
        F.coalesce(F.trim(value("vendor")), F.lit("")).alias("vendor_name"),
        cleaning.parse_date(F.trim(value("date")), DATE_FORMS, day).alias("date"),
        F.coalesce(F.trim(value("description")), F.lit("")).alias("description"),
        F.coalesce(F.when(value("currency") != "", F.upper(value("currency"))), F.lit("USD")).alias("currency"),
        F.least(F.lit(0.9), 0.5 + counted * 0.1).alias("confidence"),
        counted.alias("fields_extracted"),
        F.col("__fields").alias("detected"),
    )
    return held.withColumn("core", core).drop("__fields", "__kept")


def with_standards(rows: DataFrame) -> DataFrame:
    """rows with vendor_standard and vendor_confidence of the core's vendor, each distinct name of a batch compared once; '' and 0 without one.

    Rows stay where they are: a third of them may have no vendor, and would meet in one task.
    """
    named = rows.withColumn("__vendor", cleaning.standard_vendor(F.col("core.vendor_name")))
    return named.withColumns({"vendor_standard": F.col("__vendor.vendor_standard"), "vendor_confidence": F.col("__vendor.confidence")}).drop("__vendor")


def with_dollars(rows: DataFrame, rates: DataFrame, currency: str = "currency", day: str = "day", rate: str = "rate") -> DataFrame:
    """rows with exchange_rate, exchange_date and amount_usd: dollars at 1, others at the currency's latest rate of the day or before, null if there is none."""
    keyed = rows.withColumns({"__currency": F.col("core.currency"), "__day": F.col("core.date")})
    # rates depend on currency and day alone, so these are looked up, not whole rows
    asked = keyed.select(F.col("__currency").alias("__asked"), F.col("__day").alias("__at")).where("__asked <> 'USD'").distinct()
    dated = written(asof_join(asked, rates, "__asked", "__at", rate, currency, day, out="__rate", out_at="__rate_day"), "dated")
    found = keyed.join(dated, (F.col("__currency") == F.col("__asked")) & (F.col("__day") == F.col("__at")), "left").drop("__asked", "__at")
    at = F.when(F.col("__currency") == "USD", 1.0).otherwise(F.col("__rate"))
    made = {"exchange_rate": at, "exchange_date": F.when(F.col("__currency") == "USD", F.col("__day")).otherwise(F.col("__rate_day")), "amount_usd": F.col("core.amount") * at}
    return found.withColumns(made).drop("__currency", "__day", "__rate", "__rate_day")


def checked(rows: DataFrame, low: float = 0.7) -> DataFrame:
    """rows with `issues`, sorted: amounts beyond 100 million, unknown currencies, no rate, short vendor names, years out of 1900 to 2100, low confidence."""
    core = F.col("core")
    found = {
        "amount_out_of_range": F.abs(core["amount"]) > 100_000_000,
        "currency_unknown": ~core["currency"].isin(CURRENCIES),
        "low_confidence": core["confidence"] < low,
        "no_exchange_rate": F.col("exchange_rate").isNull(),
        "vendor_too_short": (F.length(core["vendor_name"]) < 2) | (F.length(core["vendor_name"]) > 255),
        "year_out_of_range": ~F.year(core["date"]).between(1900, 2100),
    }
    return rows.withColumn("issues", F.array_compact(F.array(*(F.when(c, name) for name, c in found.items()))))


def enriched_rows(rows: DataFrame, row: str, rates: DataFrame, today: date | None = None) -> DataFrame:
    """The whole chain. Fields are analysed once and written, as the steps after read them several times."""
    return written(rows.transform(with_core_fields, row, today), "core").transform(with_standards).transform(with_dollars, rates).transform(checked)


def event_records(rows: DataFrame, file: str, position: str, hashed: list[str]) -> DataFrame:
    """rows as events: `payload`, a struct of what the chain found, and `provenance`, a struct of file, position and the hash of the named columns."""
    core = F.col("core")
    payload = F.struct(
        core["amount"].alias("amount_original"),
        core["date"].alias("date"),
        core["description"].alias("description"),
        core["vendor_name"].alias("vendor_raw"),
        "vendor_standard",
        "vendor_confidence",
        "amount_usd",
        core["currency"].alias("currency"),
        "exchange_rate",
        "exchange_date",
        core["confidence"].alias("confidence"),
    )
    provenance = F.struct(F.col(file).alias("file"), F.col(position).alias("position"), cleaning.row_hash(F.col(file), F.col(position), *map(F.col, hashed)).alias("hash"))
    return rows.withColumns({"payload": payload, "provenance": provenance, "requires_review": F.size("issues") > 0})


def learned_mappings(rows: DataFrame, user: str, confidence: float = 0.5) -> DataFrame:
    """(user, source_column, target_field, confidence, seen): what the fields of enriched rows stand for, over all rows of a user; unknown ones left out."""
    each = rows.select(user, F.explode("core.detected").alias("f")).where("f.type <> 'unknown'")
    found = each.groupBy(user, F.col("f.name").alias("source_column"), F.col("f.type").alias("target_field")).agg(F.max("f.confidence").alias("confidence"), F.count("*").alias("seen"))
    return found.where(F.col("confidence") >= confidence)


def best_mappings(mappings: DataFrame, user: str) -> DataFrame:
    """(user, target_field, source_column): the source column of the largest confidence, then most often seen, for each target."""
    rank = F.struct("confidence", "seen", F.col("source_column"))
    return mappings.groupBy(user, "target_field").agg(F.max(rank).alias("best")).select(user, "target_field", F.col("best.source_column").alias("source_column"))


def mapped_fields(rows: DataFrame, row: str, user: str, mappings: DataFrame, key: str) -> DataFrame:
    """rows with `mapped`, the row under its user's standard names; fields without a mapping keep their own. `key` must tell rows apart."""
    each = rows.select(key, user, F.explode_outer(row).alias("__name", "__value"))
    named = each.join(mappings.select(F.col(user).alias("__user"), F.col("source_column").alias("__source"), "target_field"), F.col(user).eqNullSafe(F.col("__user")) & (F.col("__name") == F.col("__source")), "left")
    # a name that two fields map to holds the first of them by their own names
    one = named.where("__name IS NOT NULL").groupBy(key, F.coalesce("target_field", "__name").alias("__as")).agg(F.min_by("__value", "__name").alias("__value"))
    packed = one.groupBy(F.col(key).alias("__key")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__as", "__value")))).alias("mapped"))
    return rows.join(packed, F.col(key) == F.col("__key"), "left").drop("__key")
