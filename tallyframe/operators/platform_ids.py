"""Identifiers of platforms in rows: found by patterns, checked, or made up where there is none.

Patterns are texts with places: {id:w} for word characters, {id:d} for digits,
{year:4d} for up to so many digits. A value must fit as a whole, whatever its case.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edits
from .checks import platform_id_verdict

# Forms of the identifiers of each platform, in the order in which they are tried.
PATTERNS = {
    "razorpay": {"payment_id": ["pay_{id:w}"], "order_id": ["order_{id:w}"], "refund_id": ["rfnd_{id:w}"], "settlement_id": ["setl_{id:w}"]},
    "stripe": {"charge_id": ["ch_{id:w}"], "payment_intent": ["pi_{id:w}"], "customer_id": ["cus_{id:w}"], "invoice_id": ["in_{id:w}"]},
    "gusto": {"employee_id": ["emp_{id:w}"], "payroll_id": ["pay_{id:w}"], "timesheet_id": ["ts_{id:w}"]},
    "quickbooks": {
        "transaction_id": ["TXN-{id:d}", "TXN{id:d}", "QB-{id:d}", "{id:d}"],
        "invoice_id": ["INV-{id:d}", "INV{id:d}", "Invoice #{id:d}", "Invoice {id:d}"],
        "vendor_id": ["VEN-{id:d}", "VEN{id:d}", "Vendor #{id:d}", "Vendor {id:d}"],
        "customer_id": ["CUST-{id:d}", "CUST{id:d}", "Customer #{id:d}", "Customer {id:d}"],
        "bill_id": ["BILL-{id:d}", "BILL{id:d}", "Bill #{id:d}", "Bill {id:d}"],
        "payment_id": ["PAY-{id:d}", "PAY{id:d}", "Payment #{id:d}", "Payment {id:d}"],
        "account_id": ["ACC-{id:d}", "ACC{id:d}", "Account #{id:d}", "Account {id:d}"],
        "class_id": ["CLASS-{id:d}", "CLASS{id:d}", "Class #{id:d}", "Class {id:d}"],
        "item_id": ["ITEM-{id:d}", "ITEM{id:d}", "Item #{id:d}", "Item {id:d}"],
        "journal_entry_id": ["JE-{id:d}", "JE{id:d}", "Journal Entry #{id:d}", "Journal Entry {id:d}"],
    },
    "xero": {"invoice_id": ["INV-{year:4d}-{number:6d}"], "contact_id": ["{part1:8w}-{part2:4w}-{part3:4w}"], "bank_transaction_id": ["BT-{id:8d}"]},
}
# Names of columns that hold identifiers, and how like them a name must be.
ID_COLUMNS, ID_COLUMN_RATIO = ["id", "reference", "number", "ref", "num", "code", "key", "identifier", "transaction_id", "order_id", "invoice_id", "payment_id", "customer_id", "vendor_id"], 80
# Confidences by where an identifier was found.
IN_ID_COLUMN, IN_COLUMN, IN_TEXT, MADE_UP = 0.9, 0.7, 0.6, 0.1
# Words of trial data and of other platforms, the ratio from which they count, and the confidence that is left.
TRIAL_WORDS, TRIAL_RATIO, TRIAL_CONFIDENCE = ["test", "dummy", "sample", "example"], 80, 0.5
OTHER_PLATFORMS, OTHER_RATIO, OTHER_CONFIDENCE = ["stripe", "paypal", "square"], 75, 0.3
KEY_FIELDS = ["amount", "date", "description", "vendor", "customer"]
_FOUND = "map<string,struct<id:string,confidence:double>>"


def as_regex(pattern: str) -> tuple[str, bool]:
    """A regular expression that a whole value must match, group 1 being the place `id` or else the first one, and whether that is a number."""
    places = re.findall(r"\{(\w+):(\d*)([wd])\}", pattern)
    chosen = next((i for i, (name, _, _) in enumerate(places) if name == "id"), 0)
    parts = re.split(r"\{\w+:\d*[wd]\}", pattern)
    out = [re.escape(parts[0]).replace(r"\ ", " ").replace(r"\#", "#").replace(r"\-", "-")]
    for i, ((_, width, kind), text) in enumerate(zip(places, parts[1:], strict=True)):
        body = (rf"\d{{1,{width}}}" if width else r"\d+") if kind == "d" else r"\w+"
        out += [f"({body})" if i == chosen else f"(?:{body})", re.escape(text).replace(r"\ ", " ").replace(r"\#", "#").replace(r"\-", "-")]
    return "(?i)^" + "".join(out) + "$", places[chosen][2] == "d"


def _parsed(value: Column, patterns: list[str]) -> Column:
    """The identifier by the first pattern that fits and gives three characters or more; null if none does. Numbers lose leading zeros."""
    out = []
    for pattern in patterns:
        regex, number = as_regex(pattern)
        found = F.regexp_extract(value, regex, 1)
        found = F.regexp_replace(found, r"^0+(?=\d)", "") if number else found
        plain = F.regexp_replace(found, "[-_]", "").rlike(r"^[\p{L}\p{N}]+$") & (F.length(found) >= 3)
        out.append(F.when(value.rlike(regex) & plain, found))
    return F.coalesce(*out)


def id_like(names: Column) -> Column:
    """Which of an array of column names are like those of identifiers."""

    @F.arrow_udf("array<boolean>")
    def run(rows: pa.Array) -> pa.Array:
        told = {n: None for row in rows.to_pylist() for n in row or ()}
        pairs = [(n.lower(), c) for n in told for c in ID_COLUMNS]
        ratios = edits.token_sort_ratios(pairs)
        for i, n in enumerate(told):
            told[n] = bool((ratios[i * len(ID_COLUMNS) : (i + 1) * len(ID_COLUMNS)] > ID_COLUMN_RATIO).any())
        return pa.array([None if row is None else [told[n] for n in row] for row in rows.to_pylist()], pa.list_(pa.bool_()))

    return run(names)


def _in_columns(entries: Column, types: dict[str, list[str]]) -> Column:
    """Identifiers of the columns in order: each column gives the first type that fits it, or stops at the first that an earlier one gave."""

    def step(found: Column, entry: Column) -> Column:
        value = F.trim(entry["value"])
        tried = F.array(*(F.struct(F.lit(t).alias("type"), _parsed(value, p).alias("id")) for t, p in types.items()))
        first = F.get(F.filter(tried, lambda c: c["id"].isNotNull() | F.map_contains_key(found, c["type"])), F.lit(0))
        made = F.struct(first["id"].alias("id"), F.when(entry["id_like"], IN_ID_COLUMN).otherwise(IN_COLUMN).alias("confidence"))
        others = F.map_filter(found, lambda k, _: k != first["type"])
        return F.when(first["id"].isNotNull(), F.map_concat(others, F.create_map(first["type"], made))).otherwise(found)

    held = F.filter(entries, lambda e: e["value"].isNotNull() & (F.trim(e["value"]) != ""))
    return F.aggregate(held, F.create_map().cast(_FOUND), step)


def _in_text(words: Column, types: dict[str, list[str]]) -> Column:
    """For each type the identifier of the first pattern that a word fits, words in order."""

    def first(pattern: str) -> Column:
        return F.get(F.array_compact(F.transform(words, lambda w: _parsed(w, [pattern]))), F.lit(0))

    each = []
    for kind, patterns in types.items():
        by_pattern = [first(p) for p in patterns]
        each.append(F.struct(F.lit(kind).alias("type"), F.coalesce(*by_pattern).alias("id")))
    found = F.filter(F.array(*each), lambda e: e["id"].isNotNull())
    return F.map_from_entries(F.transform(found, lambda e: F.struct(e["type"].alias("key"), F.struct(e["id"].alias("id"), F.lit(IN_TEXT).alias("confidence")).alias("value"))))


def made_up_id(row: Column, platform: Column) -> Column:
    """The same id for the same amount, date, description, vendor, customer and platform, always."""
    told = F.concat_ws("|", *(F.when(row[f].isNotNull(), F.concat(F.lit(f"{f}:"), row[f])) for f in KEY_FIELDS), F.concat(F.lit("platform:"), platform))
    return F.concat(platform, F.lit("_"), F.lower(F.hex(F.xxhash64(told))))


def with_platform_ids(rows: DataFrame, row: str, platform: str) -> DataFrame:
    """rows with struct `platform_ids`: ids (a map of types to id and confidence) and confidence, their mean.

    Columns come first, then the words of all values; without either the id is
    made up. A platform without patterns gives no ids and confidence 0, and so
    does a null one.
    """
    held = rows.withColumn("__names", id_like(F.map_keys(row))).withColumn("__platform", F.lower(platform))
    held = held.withColumn("__entries", F.coalesce(F.zip_with(F.map_entries(row), "__names", lambda e, i: F.struct(e["key"].alias("name"), e["value"].alias("value"), i.alias("id_like"))), F.array().cast("array<struct<name:string,value:string,id_like:boolean>>")))
    text = F.array_join(F.transform(F.filter("__entries", lambda e: F.trim(e["value"]) != ""), lambda e: e["value"]), " ")
    held = held.withColumn("__words", F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    columns, words = F.lit(None).cast(_FOUND), F.lit(None).cast(_FOUND)
    for name, types in PATTERNS.items():
        columns = F.when(F.col("__platform") == name, _in_columns(F.col("__entries"), types)).otherwise(columns)
        words = F.when(F.col("__platform") == name, _in_text(F.col("__words"), types)).otherwise(words)
    held = held.withColumn("__columns", columns)
    held = held.withColumn("__found", F.when(F.size("__columns") > 0, F.col("__columns")).otherwise(words))
    own = F.create_map(F.lit("platform_generated_id"), F.struct(made_up_id(F.col(row), F.col("__platform")).alias("id"), F.lit(MADE_UP).alias("confidence")))
    known = F.col("__platform").isin(*PATTERNS)
    ids = F.when(~known | F.col("__platform").isNull(), F.create_map().cast(_FOUND)).when(F.size("__found") > 0, F.col("__found")).otherwise(own)
    held = held.withColumn("__ids", ids)
    mean = F.when(F.size("__ids") > 0, F.aggregate(F.map_values("__ids"), F.lit(0.0), lambda s, x: s + x["confidence"]) / F.size("__ids")).otherwise(0.0)
    return held.withColumn("platform_ids", F.struct(F.col("__ids").alias("ids"), mean.alias("confidence"))).drop("__names", "__platform", "__entries", "__words", "__columns", "__found", "__ids")


def checked_id(value: Column, platform: Column) -> Column:
    """struct(is_valid, reason, warnings, confidence) of an identifier: its form, then words of trial data and, for quickbooks, of other platforms; confidence is null without warnings."""
    verdict, low = platform_id_verdict(value, platform), F.lower(F.trim(value))
    near = lambda words, least: edits.nearest_ratio(low, words) > least
    trial = verdict["is_valid"] & near(TRIAL_WORDS, TRIAL_RATIO)
    mixed = verdict["is_valid"] & (platform == "quickbooks") & near(OTHER_PLATFORMS, OTHER_RATIO)
    warnings = F.array_compact(F.array(F.when(trial, "ID contains test/sample indicators"), F.when(mixed, "ID contains mixed platform indicators")))
    return F.struct(verdict["is_valid"].alias("is_valid"), verdict["reason"].alias("reason"), warnings.alias("warnings"), F.when(mixed, OTHER_CONFIDENCE).when(trial, TRIAL_CONFIDENCE).alias("confidence"))
