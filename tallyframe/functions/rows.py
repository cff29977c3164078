"""Rows, sheets and their patterns: keyword classes, causality words, pattern checks, weights of relationship scores, feature minimums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords anywhere in a row's text, in the order in which the classes are tried.
ROW_KEYWORDS = {"payroll": ["salary", "payroll", "wage", "employee"], "revenue": ["revenue", "income", "sales", "payment received"], "expense": ["expense", "cost", "bill", "invoice", "payment"]}
# Keywords that count as whole words only.
WORD_KEYWORDS = {
    "payroll": ["salary", "wage", "payroll", "employee", "compensation"],
    "revenue": ["income", "revenue", "payment received", "deposit", "credit", "sales"],
    "expense": ["expense", "cost", "bill", "payment", "debit", "withdrawal", "fee"],
}
# Row type and subcategory of each category.
ROW_TYPES = {"payroll": ("payroll_expense", "employee_salary"), "revenue": ("revenue_income", "client_payment"), "expense": ("operating_expense", "operating_cost"), "other": ("transaction", "general")}
# Words for a temporal causality.
CAUSALITIES = ["source_causes_target", "target_causes_source", "bidirectional", "correlation_only", "unknown"]
CAUSALITY_ALIASES = {
    "source_to_target": "source_causes_target", "forward_causality": "source_causes_target", "target_to_source": "target_causes_source", "reverse_causality": "target_causes_source",
    "mutual_causality": "bidirectional", "two_way": "bidirectional", "correlation": "correlation_only", "no_causality": "correlation_only",
}
# Parts of column names that speak for a kind of sheet, in the order in which ties are decided.
SHEET_FIELDS = {
    "profit_loss": ["revenue", "income", "sales", "earnings", "turnover", "gross_revenue", "net_revenue", "expenses", "costs", "operating_expenses", "cogs", "cost_of_goods_sold", "admin_expenses", "profit", "net_income", "ebitda", "gross_profit", "operating_profit"],
    "balance_sheet": ["assets", "current_assets", "fixed_assets", "total_assets", "cash", "inventory", "receivables", "liabilities", "current_liabilities", "long_term_debt", "total_liabilities", "payables", "equity", "shareholders_equity", "retained_earnings", "capital"],
    "cashflow": ["operating_cash_flow", "cash_from_operations", "operating_activities", "investing_cash_flow", "cash_from_investing", "investing_activities", "financing_cash_flow", "cash_from_financing", "financing_activities"],
}
# Transactions that a feature needs at least.
FEATURE_MINIMUMS = {"causal_analysis": 30, "temporal_forecasting": 50, "relationship_mapping": 20, "anomaly_detection": 10}
# Error codes of spreadsheet cells.
CELL_ERRORS = ["#REF!", "#VALUE!", "#DIV/0!", "#NAME!", "#NUM!"]
# Weights of amount, date, entity, id and context, and what some types put in their place; the sum is not brought back to 1.
WEIGHTS = {"amount": 0.3, "date": 0.2, "entity": 0.2, "id": 0.2, "context": 0.1}
TYPE_WEIGHTS = {
    "invoice_to_payment": {"amount": 0.4, "id": 0.3}, "payment_to_invoice": {"amount": 0.4, "id": 0.3},
    "revenue_to_cashflow": {"date": 0.3, "amount": 0.3}, "expense_to_bank": {"date": 0.3, "amount": 0.3}, "payroll_to_bank": {"entity": 0.3, "date": 0.3},
}


def _row_class(category: Column, confidence: Column) -> Column:
    of = lambda i: F.create_map(*(F.lit(x) for k, v in ROW_TYPES.items() for x in (k, v[i])))[category]
    return F.struct(of(0).alias("row_type"), category.alias("category"), of(1).alias("subcategory"), confidence.alias("confidence"))


def row_class(*values: Column) -> Column:
    """struct(row_type, category, subcategory, confidence) of a row by keywords anywhere in its values; nulls are left out."""
    text = F.lower(F.concat_ws(" ", *(v.cast("string") for v in values)))
    category = F.coalesce(*(F.when(F.greatest(*(text.contains(w).cast("int") for w in words), F.lit(0)) == 1, k) for k, words in ROW_KEYWORDS.items()), F.lit("other"))
    return _row_class(category, F.when(category == "other", 0.6).otherwise(0.75))


def fallback_row_class(*values: Column) -> Column:
    """As row_class, by whole words; values that read `nan` are left out, too, and the confidence is always 0.3."""
    text = F.lower(F.concat_ws(" ", *(F.when(F.lower(F.trim(v.cast("string"))) != "nan", v.cast("string")) for v in values)))
    whole = lambda words: rf"(^|[^a-z0-9_])({'|'.join(words)})([^a-z0-9_]|$)"
    category = F.coalesce(*(F.when(text.rlike(whole(words)), k) for k, words in WORD_KEYWORDS.items()), F.lit("other"))
    return _row_class(category, F.lit(0.3))


def temporal_causality(value: Column) -> Column:
    """The allowed value, the alias' value, that of the first alias which the text begins with, else unknown; so for null and empty text."""
    v = F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_"))
    exact = F.create_map(*(F.lit(x) for kv in CAUSALITY_ALIASES.items() for x in kv))[v]
    prefix = (F.when(v.startswith(k), name) for k, name in CAUSALITY_ALIASES.items())
    return F.coalesce(F.when(v.isin(CAUSALITIES), v), exact, *prefix, F.lit("unknown"))


def pattern_is_valid(text: Column) -> Column:
    """Whether a JSON text has the four typed keys and a confidence of 0 to 1; null for null or for what is no JSON."""
    v = F.try_parse_json(text)
    kind = lambda key: F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    number = F.try_variant_get(v, "$.confidence_score", "double")
    is_number = kind("confidence_score").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    ok = (kind("pattern_type") == "STRING") & is_number & (kind("detection_method") == "STRING") & kind("pattern_data").startswith("OBJECT") & number.between(0, 1)
    return F.when(v.isNotNull(), F.coalesce(ok, F.lit(False)))


def sheet_type(names: Column) -> Column:
    """struct(sheet_type, confidence, indicators) of an array of column names: the kind that most of its fields are found for."""
    clean = F.transform(F.filter(names, lambda n: n.isNotNull() & (F.lower(n) != "nan")), lambda n: F.lower(F.trim(n)))
    hits = {k: F.filter(F.array(*map(F.lit, fields)), lambda f: F.exists(clean, lambda n: F.contains(n, f))) for k, fields in SHEET_FIELDS.items()}
    most = F.greatest(*(F.size(h) for h in hits.values()))
    kind = F.when(most == 0, "unknown")
    for k, h in hits.items():
        kind = kind.when(F.size(h) == most, k)
    confidence = F.when(most > 0, F.least(most / F.size(clean), F.lit(1.0))).otherwise(0.0)
    return F.struct(kind.alias("sheet_type"), confidence.alias("confidence"), F.array_sort(F.array_distinct(F.concat(*hits.values()))).alias("indicators"))


def weighted_score(kind: Column, **scores: Column) -> Column:
    """Sum of the scores of amount, date, entity, id and context under the weights of the type."""
    def weight(name: str) -> Column:
        own = {t: w[name] for t, w in TYPE_WEIGHTS.items() if name in w}
        other = F.lit(WEIGHTS[name])
        return F.coalesce(F.create_map(*(F.lit(x) for kv in own.items() for x in kv))[kind], other) if own else other

    return sum((weight(name) * scores[name] for name in WEIGHTS), F.lit(0.0))


def lineage_summary(path: Column) -> Column:
    """struct of a path's (step, at) length, steps, seconds from first to last, and which stages it holds; zero for an empty path."""
    has = lambda s: F.exists(path, lambda x: x["step"] == s)
    seconds = F.unix_micros(F.element_at(path, -1)["at"]) - F.unix_micros(F.element_at(path, 1)["at"])
    stages = (has(s).alias(f"has_{n}") for n, s in {"ai_classification": "classification", "enrichment": "enrichment", "entity_resolution": "entity_resolution"}.items())
    return F.struct(F.size(path).alias("total_steps"), F.array_join(path["step"], ",").alias("steps"), F.when(F.size(path) > 0, seconds / 1e6).otherwise(0.0).alias("duration_seconds"), *stages)


def character_entropy(text: Column) -> Column:
    """Bits per character of a whole text, counted by what replacing each distinct character removes; null for an empty text."""
    n = F.length(text)
    count = lambda c: n - F.length(F.replace(text, c, F.lit("")))
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: count(c) / n)
    return F.when(n > 0, -F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def feature_access(feature: Column, transactions: Column) -> Column:
    """Whether so many transactions open the feature; unknown features are open."""
    least = F.create_map(*(F.lit(x) for kv in FEATURE_MINIMUMS.items() for x in kv))[feature]
    return F.coalesce(transactions >= least, F.lit(True))
