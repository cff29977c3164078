"""Identifiers of platforms by a plain walk over columns, types and words."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from tallyframe.operators import platform_ids as ids


def plain(row, platform):
    types = ids.PATTERNS.get((platform or "").lower())
    if not types:
        return {}

    def fit(value, patterns):
        for p in patterns:
            regex, number = ids.as_regex(p)
            if m := re.match(regex, value):
                found = str(int(m[1])) if number else m[1]
                if len(found) >= 3 and found.replace("-", "").replace("_", "").isalnum():
                    return found

    found = {}
    for value in (row or {}).values():
        value = (value or "").strip()
        for kind, patterns in types.items() if value else ():
            if (x := fit(value, patterns)) is not None:
                found[kind] = x
            if kind in found:
                break
    if not found:
        words = " ".join(v for v in (row or {}).values() if v and v.strip()).split()
        for kind, patterns in types.items():
            for p in patterns:
                if hits := [x for w in words if (x := fit(w, [p]))]:
                    found[kind] = hits[0]
                    break
    return found


ROWS = [
    ({"id": "ch_1234", "b": "cus_ab9", "c": "ch_zzz"}, "stripe"), ({"a": "in_999", "b": "pi_88_8", "c": "in_777"}, "Stripe"), ({"note": "got ch_abc and pi_def, ch_ghi"}, "stripe"), ({"x": "ch_12"}, "stripe"),
    ({"n": "00012345"}, "quickbooks"), ({"n": "Journal Entry #4567"}, "quickbooks"), ({"n": "invoice 0099"}, "quickbooks"), ({"n": "text with VEN-1234 in it"}, "quickbooks"), ({"n": "TXN-12345", "m": "CUST77777"}, "quickbooks"),
    ({"n": "abcd1234-ef12-ab34"}, "xero"), ({"n": "BT-12345678"}, "xero"), ({"n": "BT-123456789"}, "xero"), ({"n": None, "m": "  "}, "gusto"), ({}, "gusto"), (None, "gusto"), ({"n": "emp_1"}, None), ({"n": "emp_1234"}, "nobody"), ({"n": "EMP_12Ab"}, "GUSTO"),
]


def test_ids_equal_a_plain_walk(spark):
    texts = [(i, None if row is None else json.dumps(row), p) for i, (row, p) in enumerate(ROWS)]
    df = spark.createDataFrame(texts, "i int, text string, platform string").withColumn("row", F.from_json("text", "map<string,string>"))
    for r in ids.with_platform_ids(df, "row", "platform").collect():
        row, platform = ROWS[r["i"]]
        want, got = plain(row, platform), r["platform_ids"]["ids"]
        if want:
            assert {k: v["id"] for k, v in got.items()} == want, (row, got)
        elif (platform or "").lower() in ids.PATTERNS:
            assert list(got) == ["platform_generated_id"] and got["platform_generated_id"]["confidence"] == 0.1
        else:
            assert got == {} and r["platform_ids"]["confidence"] == 0.0


def test_places_and_made_up_ids(spark):
    df = spark.createDataFrame([(["id", "Order ID", "customer", None], 1), (None, 2)], "names array<string>, i int")
    assert [r["x"] for r in df.where("i = 1").select(ids.id_like(F.array(F.lit("id"), F.lit("order_id"), F.lit("memo"), F.lit("numbers"))).alias("x")).collect()] == [[True, True, False, True]]
    rows = spark.createDataFrame([('{"amount":"5","date":"d"}',), ('{"date":"d","amount":"5","zzz":"1"}',), ('{"amount":"6"}',)], "text string").withColumn("row", F.from_json("text", "map<string,string>"))
    one, two, three = (r["x"] for r in rows.select(ids.made_up_id(F.col("row"), F.lit("stripe")).alias("x")).collect())
    assert one == two != three and one.startswith("stripe_")


def test_checks(spark):
    rows = [("TXN-123", "quickbooks"), ("  ", "stripe"), ("x" * 51, "gusto"), ("sample-1", "gusto"), ("ch_1", "stripe"), ("TXN-1", None), (None, "xero")]
    got = [tuple(r["c"]) for r in spark.createDataFrame(rows, "v string, p string").select(ids.checked_id(F.col("v"), F.col("p")).alias("c")).collect()]
    assert [g[0] for g in got] == [True, False, False, True, False, True, False]
    assert got[3][2:] == (["ID contains test/sample indicators"], 0.5) and got[0][2:] == ([], None)
