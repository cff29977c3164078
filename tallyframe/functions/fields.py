"""What a field of a row is: its format by its value, its meaning by its name.

Patterns are tried in the order of the tables, without regard to case. A field's
confidence is the sum of what its format and its meaning give, at most 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats with their patterns and confidences, in the order in which they are tried; e-mail, url and uuid come first.
FORMATS = [
    ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", 0.95),
    ("url", r"^https?://[^\s]+$", 0.92),
    ("uuid", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", 0.98),
    ("phone", r"^\+?[\d\s\-\(\)]{10,}$", 0.85),
    ("decimal", r"^\d+\.\d+$", 0.8),
    ("integer", r"^\d+$", 0.7),
    ("currency_amount", r"^\$?[\d,]+\.?\d*$", 0.9),
    ("date_iso", r"^\d{4}-\d{2}-\d{2}", 0.95),
    ("date_us", r"^\d{1,2}/\d{1,2}/\d{4}$", 0.9),
    ("ssn", r"^\d{3}-\d{2}-\d{4}$", 0.95),
    ("credit_card", r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$", 0.95),
    ("zip_code", r"^\d{5}(-\d{4})?$", 0.9),
    ("ip_address", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", 0.92),
]
# Meanings of field names by category, with their confidence and patterns, in the order in which they are tried.
MEANINGS = [
    ("financial", "amount", 0.7, "amount total price cost fee charge value sum balance payment revenue expense income profit loss debit credit"),
    ("financial", "currency", 0.6, "currency curr ccy usd eur gbp inr jpy cad aud chf cny krw sgd"),
    ("financial", "transaction_id", 0.8, "transaction.*id txn.*id trans.*id payment.*id order.*id invoice.*id receipt.*id ref.*id"),
    ("temporal", "date", 0.8, "date created updated timestamp time when occurred processed completed"),
    ("temporal", "period", 0.7, "period month year quarter week fiscal billing reporting"),
    ("identity", "customer", 0.7, "customer client user buyer payer account.*holder member subscriber"),
    ("identity", "vendor", 0.7, "vendor supplier merchant seller payee recipient beneficiary contractor"),
    ("identity", "id", 0.6, "^id$ identifier key code number ref reference uuid guid"),
    ("descriptive", "description", 0.6, "description desc details notes memo comment remarks narrative summary"),
    ("descriptive", "category", 0.6, "category type class group kind classification segment bucket"),
    ("descriptive", "status", 0.6, "status state condition stage phase progress outcome result"),
]


def format_of(value: Column) -> Column:
    """struct(format, confidence) of a value, white space around it left out; null if no pattern fits."""
    text, out = F.trim(value.cast("string")), F.lit(None)
    for name, pattern, confidence in reversed(FORMATS):
        out = F.when(text.rlike(f"(?i){pattern}"), F.struct(F.lit(name).alias("format"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def meaning_of(name: Column) -> Column:
    """struct(type, category, confidence, pattern) of a field name, by the first pattern found in it; null if none is."""
    out = F.lit(None)
    for category, kind, confidence, patterns in reversed(MEANINGS):
        listed = patterns.split()
        first = F.coalesce(*(F.when(name.rlike(f"(?i){p}"), p) for p in listed))
        found = F.struct(F.lit(kind).alias("type"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), first.alias("pattern"))
        out = F.when(name.rlike(f"(?i){'|'.join(listed)}"), found).otherwise(out)
    return out


def detected_fields(row: Column) -> Column:
    """array of struct(name, type, confidence, format, category, pattern) of the fields of a map of names to values, in its order.

    Fields without a value are left out; the type is unknown if a name tells
    nothing. Each field's patterns are tried once, before the parts are taken.
    """
    held = F.filter(F.coalesce(F.map_entries(row), F.array().cast("array<struct<key:string,value:string>>")), lambda e: e["value"].isNotNull())
    tried = F.transform(held, lambda e: F.struct(e["key"].alias("name"), format_of(e["value"]).alias("form"), meaning_of(e["key"]).alias("meaning")))

    def told(x: Column) -> Column:
        confidence = F.least(F.lit(1.0), F.coalesce(x["form"]["confidence"], F.lit(0.0)) + F.coalesce(x["meaning"]["confidence"], F.lit(0.0)))
        kind = F.coalesce(x["meaning"]["type"], F.lit("unknown"))
        return F.struct(x["name"].alias("name"), kind.alias("type"), confidence.alias("confidence"), x["form"]["format"].alias("format"), x["meaning"]["category"].alias("category"), x["meaning"]["pattern"].alias("pattern"))

    return F.transform(tried, told)


def mean_confidence(fields: Column) -> Column:
    """The mean over a row's fields; 0 if there is none."""
    return F.when(F.size(fields) > 0, F.aggregate(fields, F.lit(0.0), lambda s, f: s + f["confidence"]) / F.size(fields)).otherwise(0.0)


def field_suggestions(fields: Column, least: float = 0.5) -> Column:
    """struct(total_fields, recognised_fields, confidence_score, low_confidence, unknown, messages) of a row's fields; the lists hold names in the row's order."""
    low, unknown = F.filter(fields, lambda f: f["confidence"] < least), F.filter(fields, lambda f: f["type"] == "unknown")
    review = F.concat(F.lit("Review "), F.size(low).cast("string"), F.lit(" low-confidence fields"))
    define = F.concat(F.lit("Define patterns for "), F.size(unknown).cast("string"), F.lit(" unknown types"))
    names = lambda some: F.transform(some, lambda f: f["name"])
    return F.struct(
        F.size(fields).alias("total_fields"),
        (F.size(fields) - F.size(unknown)).alias("recognised_fields"),
        mean_confidence(fields).alias("confidence_score"),
        names(low).alias("low_confidence"),
        names(unknown).alias("unknown"),
        F.array_compact(F.array(F.when(F.size(low) > 0, review), F.when(F.size(unknown) > 0, define))).alias("messages"),
    )
