"""Cleaning and normalisation of amounts, dates, names and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .edits import token_sort_ratio

# Business suffixes, in the order in which each is stripped once.
BUSINESS_SUFFIXES = ["inc", "inc.", "llc", "ltd", "ltd.", "corp", "corp.", "co", "co.", "company", "incorporated", "limited", "corporation", "limited liability company"]
# Units of a currency in US dollars.
USD_RATES = {
    "EUR": 1.09, "GBP": 1.27, "INR": 0.012, "JPY": 0.0067, "CNY": 0.14, "AUD": 0.65, "CAD": 0.73, "CHF": 1.16, "SGD": 0.75, "HKD": 0.13,
    "NZD": 0.60, "SEK": 0.096, "NOK": 0.093, "MXN": 0.058, "BRL": 0.20, "ZAR": 0.055, "RUB": 0.011, "KRW": 0.00076, "TRY": 0.029, "AED": 0.27,
}
SQL_INJECTION = r"(?i)(union\s+select|drop\s+table|insert\s+into|delete\s+from|update\s+\w+\s+set|;\s*--|'\s*or\s*'?1'?\s*=\s*'?1|exec\s*\()"
PATH_TRAVERSAL = r"(?i)(\.\./|\.\.\\|%2e%2e|^/|^[a-z]:\\)"


def clean_vendor(name: Column) -> Column:
    """Trimmed, each suffix stripped once from the end, punctuation to spaces, in title case; the raw name if nothing is left."""
    stripped = lambda n, suffix: F.when(F.endswith(F.lower(n), suffix), F.trim(F.left(n, F.length(n) - F.length(suffix)))).otherwise(n)
    out = F.aggregate(F.array(*map(F.lit, BUSINESS_SUFFIXES)), F.trim(name), stripped)
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}\s]", " "), r"\s+", " ")))
    titled = F.array_join(F.transform(F.split(plain, r"(?<=\p{N})(?=\p{L})"), F.initcap), "")  # a letter after a digit is a capital, too
    return F.when(titled == "", name).otherwise(titled)


def parse_amount(raw: Column) -> Column:
    """Digits, point and minus as a double; 0.0 where they make no number."""
    return F.coalesce(F.regexp_replace(raw.cast("string"), r"[^0-9.\-]", "").try_cast("double"), F.lit(0.0))


def parse_date(raw: Column, formats: list[str], fallback: Column) -> Column:
    """The first format that fits."""
    return F.coalesce(*(F.try_to_timestamp(raw, F.lit(f)).cast("date") for f in formats), fallback)


def to_usd(amount: Column, currency: Column) -> Column:
    """Converted at the fixed rates; null for an unknown currency."""
    rates = F.create_map(*(F.lit(x) for kv in USD_RATES.items() for x in kv))
    return F.when(currency == "USD", amount).otherwise(amount * rates[F.upper(currency)])


def compare_amounts(a: Column, b: Column) -> Column:
    """Smaller over larger; 0 if either is 0 or missing."""
    a, b = F.abs(a.cast("double")), F.abs(b.cast("double"))
    return F.when((a == 0) | (b == 0) | a.isNull() | b.isNull(), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def compare_dates(a: Column, b: Column) -> Column:
    """1 on the same day, then .9, .7 within a week, .5 within 30 days, else .2; 0 if either is missing."""
    days = F.abs(F.datediff(a, b))
    return F.when(days.isNull(), 0.0).when(days == 0, 1.0).when(days == 1, 0.9).when(days <= 7, 0.7).when(days <= 30, 0.5).otherwise(0.2)


def normalise_filename(name: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(name)), r"(?i)[_\-\s]*(v\d+(\.\d+)*|version\s*\d+|final|draft|copy|\(\d+\))", "")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", "_"), "_+", "_")


def version_of(name: Column) -> Column:
    found = F.regexp_extract(F.lower(name), r"(v\d+(?:\.\d+)*|final|draft)", 1)
    return F.when(found == "", "v1").otherwise(found)


def tokens(*columns: Column) -> Column:
    """Distinct lower-case tokens of more than one character, sorted."""
    words = F.split(F.lower(F.concat_ws(" ", *columns)), r"[\s,;]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 1)))


def row_hash(file: Column, row: Column, *columns: Column) -> Column:
    return F.sha2(F.concat_ws("||", file.cast("string"), row.cast("string"), F.array_join(tokens(*columns), " ")), 256)


def sanitise(text: Column, limit: int = 1000) -> Column:
    """Null where the text looks like an attack; else without tags and control characters, cut to limit."""
    safe = F.substring(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), 1, limit)
    return F.when(text.rlike(SQL_INJECTION) | text.rlike(PATH_TRAVERSAL), None).otherwise(safe)


def standard_vendor(raw: Column) -> Column:
    """struct(vendor_standard, confidence, method): the cleaned name; .7 and a quarter of how like it is to the raw one, at most .95. Empty names give ''."""
    says_nothing = raw.isNull() | (F.trim(raw) == "")
    cleaned = clean_vendor(raw)
    alike = token_sort_ratio(F.lower(raw), F.lower(cleaned)) / 100
    made = F.struct(cleaned.alias("vendor_standard"), F.least(F.lit(0.95), 0.7 + alike * 0.25).alias("confidence"), F.lit("edit_ratio").alias("method"))
    return F.when(says_nothing, F.struct(F.lit("").alias("vendor_standard"), F.lit(0.0).alias("confidence"), F.lit("empty").alias("method"))).otherwise(made)
