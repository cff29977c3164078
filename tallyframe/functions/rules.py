"""Rule tables compiled to columns: aliases, payload checks, platforms, document types, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of business logic, other words for them in the order in which their beginnings are tried, and words for kinds of entities.
BUSINESS_LOGIC = ["standard_payment_flow", "revenue_recognition", "expense_reimbursement", "payroll_processing", "tax_withholding", "asset_depreciation", "loan_repayment", "refund_processing", "recurring_billing", "unknown"]
BUSINESS_LOGIC_ALIASES = {
    "invoice_payment": "standard_payment_flow",
    "vendor_payment": "standard_payment_flow",
    "vendor_payments": "standard_payment_flow",
    "payment_workflow": "standard_payment_flow",
    "cash_outflow": "standard_payment_flow",
    "cash_inflow": "revenue_recognition",
    "revenue_collection": "revenue_recognition",
    "recurring_revenue": "recurring_billing",
    "subscription_billing": "recurring_billing",
    "refunds": "refund_processing",
    "loan_payments": "loan_repayment",
    "asset_management": "asset_depreciation",
    "depreciation_schedule": "asset_depreciation",
    "payroll": "payroll_processing",
    "tax_payments": "tax_withholding",
    "expense_management": "expense_reimbursement",
    "predictable_pattern": "recurring_billing",
    "historical_pattern": "recurring_billing",
    "pattern_based": "recurring_billing",
}
ENTITY_KINDS = {
    "employees": "employee", "vendors": "vendor", "customers": "customer", "projects": "project", "contacts": "contact",
    "employee": "employee", "vendor": "vendor", "customer": "customer", "project": "project", "contact": "contact",
    "supplier": "vendor", "suppliers": "vendor", "client": "customer", "clients": "customer", "person": "contact", "people": "contact",
}
ID_PATTERNS = {"invoice": r"(?i)\bINV[-_]?(\d+)", "order": r"(?i)\b(?:PO|ORD)[-_]?(\d+)", "customer": r"(?i)\bCustomer#(\d+)"}
# Currencies that amounts may have.
CURRENCIES = ["USD", "EUR", "GBP", "INR", "JPY", "CNY", "AUD", "CAD", "CHF", "SEK", "NZD"]


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def business_logic(value: Column) -> Column:
    """One of BUSINESS_LOGIC: the value itself, what it is another word for, or what it begins with; unknown else. Null and empty values are the standard flow."""
    v = F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_"))
    begins = F.coalesce(*(F.when(v.startswith(k), name) for k, name in BUSINESS_LOGIC_ALIASES.items()), F.lit("unknown"))
    return F.when(value.isNull() | (value == ""), "standard_payment_flow").when(v.isin(BUSINESS_LOGIC), v).otherwise(F.coalesce(_lookup(BUSINESS_LOGIC_ALIASES)[v], begins))


def entity_kind(value: Column) -> Column:
    """employee, vendor, customer or project by the word for it, whatever its case; contact for all else."""
    return F.coalesce(_lookup(ENTITY_KINDS)[F.lower(value)], F.lit("contact"))


def checked_payload(amount: Column, currency: Column, confidence: Column) -> Column:
    """struct(amount_ok, currency, confidence): unknown currencies become USD, confidences outside 0 to 1 become .5."""
    return F.struct(
        (F.abs(amount) <= 100_000_000).alias("amount_ok"), F.when(currency.isin(CURRENCIES), currency).otherwise("USD").alias("currency"), F.when(confidence.between(0, 1), confidence).otherwise(0.5).alias("confidence")
    )


def found_ids(text: Column) -> Column:
    """Sorted kind:number strings of all identifiers in a text."""

    def tagged(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.concat(F.lit(f"{kind}:"), x))

    return F.array_sort(F.array_distinct(F.concat(*(tagged(k, p) for k, p in ID_PATTERNS.items()))))


def relationship_score(amount: Column, date: Column, entity: Column, ids: Column, context: Column) -> Column:
    return F.least(F.lit(1.0), 0.3 * amount + 0.2 * date + 0.2 * entity + 0.2 * ids + 0.1 * context)


def first_rule(rules: list[tuple[str, str]], other: str) -> Column:
    """rules: (SQL condition, outcome); the first that holds."""
    return F.coalesce(*(F.when(F.expr(c), name) for c, name in rules), F.lit(other))


def minhash(words: Column, slots: int = 32) -> Column:
    """Signature of a set of strings: the least salted hash in each slot."""
    return F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda s: F.array_min(F.transform(words, lambda w: F.xxhash64(s, w))))


def minhash_similarity(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def tfidf_class(docs: DataFrame, key: str, words: Column, profiles: dict[str, list[str]]) -> DataFrame:
    """(key, label, score): the profile whose words weigh most in each document, by smoothed inverse document frequency.

    Only profile words leave the scan; their number is bounded by the profiles.
    """
    vocabulary = sorted({w for ws in profiles.values() for w in ws})
    held = docs.select(key, F.explode(F.filter(words, lambda w: w.isin(vocabulary))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("tf"))
    total = docs.agg(F.count("*").alias("n_docs"))
    idf = held.groupBy("w").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("w", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    spoken = docs.sparkSession.createDataFrame([(w, label) for label, ws in profiles.items() for w in ws], "w string, label string")
    scored = held.join(F.broadcast(idf), "w").join(F.broadcast(spoken), "w").groupBy(key, "label").agg(F.sum(F.col("tf") * F.col("idf")).alias("score"))
    return scored.groupBy(key).agg(F.max_by(F.struct("label", "score"), F.struct("score", "label")).alias("best")).select(key, "best.*")
