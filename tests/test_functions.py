from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import classify, cleaning, rows, similarity
from tallyframe.operators import rows as row_ops
from tallyframe.sources import files
from tallyframe.streaming import rates


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cleaning(spark):
    assert one(spark, cleaning.clean_vendor(F.lit("  acme widgets, Inc. "))) == "Acme Widgets"
    assert one(spark, cleaning.clean_vendor(F.lit("..."))) == "..."
    assert one(spark, cleaning.clean_vendor(F.lit("Costco"))) == "Cost" and one(spark, cleaning.clean_vendor(F.lit("3m o'neil co. ltd"))) == "3M O Neil"
    assert one(spark, cleaning.parse_amount(F.lit("$ -1,234.50"))) == -1234.5
    assert one(spark, cleaning.parse_amount(F.lit("none"))) == 0.0
    assert str(one(spark, cleaning.parse_date(F.lit("03/02/2024"), ["yyyy-MM-dd", "dd/MM/yyyy"], F.lit(None)))) == "2024-02-03"
    assert one(spark, cleaning.normalise_filename(F.lit("Report Q1 final v2.csv"))) == "report_q1.csv"
    assert one(spark, cleaning.version_of(F.lit("report_v2.1.csv"))) == "v2.1"
    assert one(spark, cleaning.sanitise(F.lit("a <b>bold</b> text"))) == "a bold text"
    assert one(spark, cleaning.sanitise(F.lit("x'; DROP TABLE users"))) is None
    assert abs(one(spark, cleaning.to_usd(F.lit(10.0), F.lit("EUR"))) - 10.9) < 1e-9


def test_similarity(spark):
    assert one(spark, similarity.name_similarity(F.lit("Acme  Corp"), F.lit("acme corp"))) == 1.0
    assert 0 < one(spark, similarity.name_similarity(F.lit("acme corp"), F.lit("acme corporation"))) < 1
    vector = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(spark, similarity.cosine(vector(1, 0), vector(0, 0))) == 0.0
    assert abs(one(spark, similarity.cosine(vector(1, 1), vector(2, 2))) - 1) < 1e-12


def test_classify(spark):
    assert one(spark, classify.field_format(F.lit("a@b.com"))) == "email"
    assert one(spark, classify.field_meaning(F.lit("vendor_name"))) == "vendor"
    assert abs(one(spark, classify.shannon_entropy(F.lit("aabb"))) - 1.0) < 1e-9


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,N/A\n")
    rows = files.read_any(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [r["name"] for r in rows] == ["x", None]
    good, bad = files.quarantine(spark.createDataFrame([(1,), (-1,), (None,)], "x int"), {"positive": "x > 0"})
    assert good.count() == 1 and bad.count() == 2
    for _ in range(2):
        files.write_batch(spark.range(3), str(tmp_path / "out"), "b1")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert files.file_hashes(spark, str(tmp_path / "a.csv")).first()["kind"] == "text"


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:02"), (2, "2024-01-01 00:00:03")], "user_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = rates.once_within(rates.event_stream(spark, str(tmp_path / "in"), events.schema), ["user_id"], "ts", "10 minutes")
    query = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("once").count() == 2
    assert {r["user_id"]: r["limited"] for r in rates.rate_windows(events, "user_id", "ts", "1 minute", 1).collect()} == {1: True, 2: False}


def test_rows(spark):
    assert one(spark, rows.row_class(F.lit("Employee of the month"), F.lit(None)))[:2] == ("payroll_expense", "payroll")
    assert one(spark, rows.row_class(F.lit(None), F.lit(7)))[1:] == ("other", "general", 0.6)
    assert one(spark, rows.fallback_row_class(F.lit("wages"), F.lit("nan")))["category"] == "other"
    assert one(spark, rows.fallback_row_class(F.lit("nan"), F.lit("a fee, paid")))["category"] == "expense"
    assert [one(spark, rows.temporal_causality(F.lit(v))) for v in ("Two Way", "no causality at all", "", None, "target_causes_source")] == ["bidirectional", "correlation_only", "unknown", "unknown", "target_causes_source"]
    assert one(spark, rows.pattern_is_valid(F.lit("{"))) is None and one(spark, rows.pattern_is_valid(F.lit("[1]"))) is False
    assert one(spark, rows.sheet_type(F.array(F.lit("Cash"), F.lit("Income"), F.lit(None), F.lit("x"))))[:2] == ("profit_loss", 1 / 3)
    assert one(spark, rows.sheet_type(F.array().cast("array<string>")))[:2] == ("unknown", 0.0)
    assert one(spark, rows.character_entropy(F.lit("aabb"))) == 1.0 and one(spark, rows.character_entropy(F.lit("\u00e9\U0001f600"))) == 1.0 and one(spark, rows.character_entropy(F.lit(""))) is None
    full = {k: F.lit(1.0) for k in rows.WEIGHTS}
    assert [round(one(spark, rows.weighted_score(F.lit(t), **full)), 9) for t in ("payroll_to_bank", "invoice_to_payment", None)] == [1.2, 1.2, 1.0]


def test_sheet_anomalies_and_decisions(spark):
    cells = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (1, "#NUM!", -1), (1, None, None), (2, "y", 0)], "f int, s string, a int")
    assert sorted(tuple(r) for r in row_ops.sheet_anomalies(cells, "f", ["a"]).collect()) == [(1, 1, 2, 1, 1), (2, 0, 0, 0, 0)]
    assert row_ops.sheet_anomalies(cells.where("f = 3"), "f", ["a"]).count() == 0
    files = spark.createDataFrame([(1, 1, "h", "new"), (2, 1, "h", "new"), (3, 2, "h", "new"), (4, 1, None, "new")], "file_id int, user_id int, file_hash string, status string")
    asked = spark.createDataFrame([(2, 1, "h", "replace"), (3, 2, "h", "skip"), (4, 1, None, "replace")], "file_id int, user_id int, file_hash string, decision string")
    assert {r["file_id"]: r["status"] for r in row_ops.decided(files, asked).collect()} == {1: "replaced", 2: "new", 3: "new", 4: "new"}
