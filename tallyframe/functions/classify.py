"""Field formats, platforms, transaction semantics: ordered rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats in the order in which they are tried.
FORMATS = [
    ("email", r"^[\w.+-]+@[\w-]+\.[\w.-]+$"),
    ("url", r"^https?://\S+$"),
    ("uuid", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ("date", r"^\d{4}-\d{2}-\d{2}"),
    ("integer", r"^-?\d+$"),
    ("decimal", r"^-?\d+\.\d+$"),
    ("phone", r"^\+?[\d\s()-]{7,15}$"),
]
# Names of columns by meaning, in the order in which they are tried.
MEANINGS = [
    ("amount", r"amount|total|price|value|balance|cost"),
    ("date", r"date|time|ts$|created|updated"),
    ("identifier", r"(^|_)(id|key)$|number"),
    ("vendor", r"vendor|supplier|merchant"),
    ("customer", r"customer|client|buyer"),
    ("description", r"desc|memo|note|comment"),
    ("status", r"status|state"),
]
PII_PATTERNS = [("email", r"[\w.+-]+@[\w-]+\.[\w.-]+"), ("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), ("phone", r"\+1 \(\d{3}\) \d{3}-\d{4}"), ("card", r"\b\d{16}\b")]


def first_match(value: Column, rules: list[tuple[str, str]], other: str) -> Column:
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def field_format(value: Column) -> Column:
    return first_match(value, FORMATS, "text")


def field_meaning(name: Column) -> Column:
    return first_match(F.lower(name), MEANINGS, "unknown")


def transaction_semantics(category: Column, amount: Column) -> Column:
    """struct(transaction_type, direction, amount_signed, affects_cash) by the first keyword in the category."""
    c = F.lower(category)
    kind = (
        F.when(c.rlike("revenue|income|sales"), "income")
        .when(c.rlike("expense|cost|payroll"), "expense")
        .when(c.rlike("transfer"), "transfer")
        .when(c.rlike("refund"), "refund")
        .when(amount != 0, "expense")
        .otherwise("unknown")
    )
    direction = F.when(kind == "income", "credit").when(kind.isin("expense", "refund"), "debit").otherwise("neutral")
    signed = F.when(direction == "credit", F.abs(amount)).when(direction == "debit", -F.abs(amount)).otherwise(F.lit(0).cast("decimal(15,2)"))
    return F.struct(kind.alias("transaction_type"), direction.alias("direction"), signed.alias("amount_signed"), kind.isin("income", "expense", "refund").alias("affects_cash"))


def semantics_errors(kind: Column, direction: Column, signed: Column, affects_cash: Column) -> Column:
    """Rules that a transaction's fields break, as an array; a missing field breaks none."""
    checks = [
        F.when((kind == "income") & (direction != "credit"), "Income must have credit direction"),
        F.when((kind == "income") & (signed < 0), "Income must have positive signed amount"),
        F.when((kind == "expense") & (direction != "debit"), "Expense must have debit direction"),
        F.when((kind == "expense") & (signed > 0), "Expense must have negative signed amount"),
        F.when((kind == "transfer") & (direction != "neutral"), "Transfer must have neutral direction"),
        F.when((kind == "transfer") & affects_cash, "Transfer should not affect cash (affects_cash = false)"),
    ]
    return F.array_compact(F.array(*checks))


def semantics_verdict(errors: Column) -> Column:
    """struct(is_valid, errors, severity)."""
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), F.when(F.size(errors) > 0, "error").otherwise("none").alias("severity"))


def data_mode(n: Column) -> Column:
    return F.when(n == 0, "NO_DATA").when(n < 50, "LIMITED").otherwise("RICH")


def strength(n: Column) -> Column:
    return F.when(n >= 5, "high").when(n >= 2, "medium").otherwise("low")


def evidence_level(n: Column) -> Column:
    return F.when(n >= 20, "very_high").when(n >= 10, "high").when(n >= 5, "medium").otherwise("low")


def shannon_entropy(text: Column) -> Column:
    """Bits per character of a string."""
    n = F.length(text)
    chars = F.split(text, "")
    kinds = F.array_distinct(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return -F.aggregate(kinds, F.lit(0.0), lambda s, c: s + share(c) * F.log2(share(c)))
