"""Field detection and the row chain on odd rows."""

from __future__ import annotations

import json
import re
from datetime import date

from pyspark.sql import functions as F

from tallyframe.functions import fields
from tallyframe.operators import row_pipeline

VALUES = ["a@b.co", "https://x.y/z", "123e4567-e89b-12d3-a456-426614174000", "+1 (555) 123-4567", "2024-01-05", "12.50", "7", "$1,234.5", "1/2/2024", "123-45-6789", "4111 1111 1111 1111", "12345-6789", "10.0.0.1", "word", "", " 42 ", None]
NAMES = ["Total Amount", "ccy", "transaction_id", "order id", "Created At", "fiscal", "Client", "payee", "id", "valid", "Ref No", "Memo", "kind", "state", "zzz", "invoice_date"]


def test_formats_and_meanings_by_plain_rules(spark):
    got = spark.createDataFrame([(v,) for v in VALUES], "v string").select("v", fields.format_of(F.col("v")).alias("f")).collect()
    for r in got:
        want = next(((n, c) for n, p, c in fields.FORMATS if r["v"] is not None and re.match(p, r["v"].strip(), re.I | re.A)), None)
        assert (r["f"] and tuple(r["f"])) == want, r
    for r in spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", fields.meaning_of(F.col("n")).alias("m")).collect():
        want = next(((t, c, x, p) for c, t, x, ps in fields.MEANINGS for p in ps.split() if re.search(p, r["n"], re.I)), None)
        assert (r["m"] and tuple(r["m"])) == want, r


def test_rows_of_every_kind(spark):
    rows = [
        (1, "u", {"Amount": "1,200.50 USD", "Fee": "3", "Supplier": " ACME Ltd ", "Date": "03/02/2024", "Currency": "gbp", "memo": " x "}),
        (2, "u", {"zzz": "1"}),
        (3, "u", {}),
        (4, None, None),
        (5, "u", {"price": None, "when": "not a date", "currency": ""}),
        (6, "u", {"total": "999999999999", "payee": "B", "date": "1800-01-01", "curr": "ZZZ"}),
    ]
    texts = [(i, who, None if row is None else json.dumps(row)) for i, who, row in rows]  # which keep the order of fields
    df = spark.createDataFrame(texts, "id int, who string, text string").withColumn("row", F.from_json("text", "map<string,string>")).withColumn("n", F.lit("own column"))
    rates = spark.createDataFrame([("GBP", date(2024, 3, 1), 1.25), ("GBP", date(2024, 3, 3), 9.0)], "currency string, day date, rate double")
    out = {r["id"]: r for r in row_pipeline.enriched_rows(df, "row", rates, date(2020, 2, 2)).collect()}
    assert len(out) == 6 and all(r["n"] == "own column" for r in out.values())
    one = out[1]
    assert (one["core"]["amount"], one["core"]["vendor_name"], one["core"]["date"], one["core"]["currency"], one["core"]["description"]) == (3.0, "ACME Ltd", date(2024, 3, 2), "GBP", "x")  # the last amount counts
    assert (one["vendor_standard"], one["exchange_rate"], one["exchange_date"], one["amount_usd"], one["issues"]) == ("Acme", 1.25, date(2024, 3, 1), 3.75, [])
    for i in (2, 3, 4):
        core = out[i]["core"]
        assert (core["amount"], core["vendor_name"], core["date"], core["currency"], core["confidence"], core["fields_extracted"]) == (0.0, "", date(2020, 2, 2), "USD", 0.5, 0)
        assert (out[i]["vendor_standard"], out[i]["vendor_confidence"], out[i]["exchange_rate"]) == ("", 0.0, 1.0)
    assert out[5]["core"]["date"] == date(2020, 2, 2) and out[5]["core"]["currency"] == "USD"
    assert out[6]["issues"] == ["amount_out_of_range", "currency_unknown", "no_exchange_rate", "vendor_too_short", "year_out_of_range"]
    told = df.select("id", fields.detected_fields(F.col("row")).alias("f")).select("id", fields.field_suggestions(F.col("f")).alias("s"))
    said = {r["id"]: r["s"] for r in told.collect()}
    assert said[2]["unknown"] == ["zzz"] and said[2]["messages"] == ["Define patterns for 1 unknown types"] and said[4]["total_fields"] == 0 and said[4]["confidence_score"] == 0


def test_mappings_are_learned_and_applied(spark):
    rows = spark.createDataFrame([(1, "u", {"Total": "5", "x": "y"}), (2, "u", {"Total": "6", "Cost": "7"}), (3, None, {"Cost": "8"}), (4, "u", None)], "id int, who string, row map<string,string>")
    core = row_pipeline.with_core_fields(rows, "row", date(2020, 1, 1))
    best = row_pipeline.best_mappings(row_pipeline.learned_mappings(core, "who"), "who")
    assert {(r["who"], r["target_field"], r["source_column"]) for r in best.collect()} == {("u", "amount", "Total"), (None, "amount", "Cost")}
    mapped = {r["id"]: r["mapped"] for r in row_pipeline.mapped_fields(rows, "row", "who", best, "id").collect()}
    assert mapped == {1: {"amount": "5", "x": "y"}, 2: {"amount": "6", "Cost": "7"}, 3: {"amount": "8"}, 4: None}


def test_rows_without_vendor_stay_where_they_are(spark):
    """They were shuffled by vendor into one task, and whole rows were sorted by currency and day."""
    rows = spark.range(300).select("id", F.create_map(F.lit("price"), F.lit("5"), F.lit("ccy"), F.when(F.col("id") % 2 == 0, "EUR").otherwise("USD"), F.lit("date"), F.lit("2024-03-02")).alias("row"))
    rates = spark.createDataFrame([("EUR", date(2024, 3, 1), 1.5)], "currency string, day date, rate double")
    found = row_pipeline.enriched_rows(rows, "row", rates, date(2020, 2, 2))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"] % 2, r["amount_usd"], r["vendor_standard"], r["exchange_date"]) for r in found.collect()} == {(0, 7.5, "", date(2024, 3, 1)), (1, 5.0, "", date(2024, 3, 2))}
