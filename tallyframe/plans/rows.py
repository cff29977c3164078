"""Queries over rows, sheets and patterns, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, rows, rules, similarity
from ..operators import rows as ops
from ..sources.adapters import LEDGER_SQL, RELATIONSHIPS_SQL, ledger_events, relationships, table
from ..sources.records import ctes, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The views as subqueries for DuckDB.
_MEMOS, _TOLD, _JSONS, _CELLS, _HEADERS, _FILES, _DECISIONS = (ctes(name).split(" AS ", 1)[1] for name in ("memos", "told", "pattern_bodies", "cells", "headers", "named_files", "decisions"))


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _any(words: list[str]) -> str:
    return " OR ".join(f"contains(t, '{w}')" for w in words)


def _whole(words: list[str]) -> str:
    return f"regexp_matches(t, '(^|[^a-z0-9_])({'|'.join(words)})([^a-z0-9_]|$)')"


_TYPES = "CASE category WHEN 'payroll' THEN 'payroll_expense' WHEN 'revenue' THEN 'revenue_income' WHEN 'expense' THEN 'operating_expense' ELSE 'transaction' END AS row_type, category, CASE category WHEN 'payroll' THEN 'employee_salary' WHEN 'revenue' THEN 'client_payment' WHEN 'expense' THEN 'operating_cost' ELSE 'general' END AS subcategory"


@_query("row_classes", f"""WITH m AS (SELECT event_id, lower(concat_ws(' ', memo, priority)) AS t FROM {_MEMOS}), c AS (SELECT event_id, CASE WHEN {_any(['salary', 'payroll', 'wage', 'employee'])} THEN 'payroll' WHEN {_any(['revenue', 'income', 'sales', 'payment received'])} THEN 'revenue'
 WHEN {_any(['expense', 'cost', 'bill', 'invoice', 'payment'])} THEN 'expense' ELSE 'other' END AS category FROM m) SELECT event_id, {_TYPES}, CAST(CASE category WHEN 'other' THEN 0.6 ELSE 0.75 END AS DOUBLE) AS confidence FROM c""")
def row_classes(spark, sf_dir):
    return view(spark, sf_dir, "memos").select("event_id", rows.row_class(F.col("memo"), F.col("priority")).alias("c")).select("event_id", "c.*")


@_query("fallback_row_classes", f"""WITH m AS (SELECT event_id, lower(concat_ws(' ', nullif(memo, 'nan'), priority)) AS t FROM {_MEMOS}), c AS (SELECT event_id, CASE WHEN {_whole(['salary', 'wage', 'payroll', 'employee', 'compensation'])} THEN 'payroll' WHEN {_whole(['income', 'revenue', 'payment received', 'deposit', 'credit', 'sales'])} THEN 'revenue'
 WHEN {_whole(['expense', 'cost', 'bill', 'payment', 'debit', 'withdrawal', 'fee'])} THEN 'expense' ELSE 'other' END AS category FROM m) SELECT event_id, {_TYPES}, CAST(0.3 AS DOUBLE) AS confidence FROM c""")
def fallback_row_classes(spark, sf_dir):
    return view(spark, sf_dir, "memos").select("event_id", rows.fallback_row_class(F.col("memo"), F.col("priority")).alias("c")).select("event_id", "c.*")


@_query("temporal_causalities", f"""SELECT id, CASE WHEN told IS NULL OR told = '' THEN 'unknown' WHEN v IN ('source_causes_target', 'target_causes_source', 'bidirectional', 'correlation_only', 'unknown') THEN v WHEN starts_with(v, 'source_to_target') OR starts_with(v, 'forward_causality') THEN 'source_causes_target'
 WHEN starts_with(v, 'target_to_source') OR starts_with(v, 'reverse_causality') THEN 'target_causes_source' WHEN starts_with(v, 'mutual_causality') OR starts_with(v, 'two_way') THEN 'bidirectional' WHEN starts_with(v, 'correlation') OR starts_with(v, 'no_causality') THEN 'correlation_only' ELSE 'unknown' END AS causality
 FROM (SELECT id, told, replace(lower(trim(told)), ' ', '_') AS v FROM {_TOLD})""")
def temporal_causalities(spark, sf_dir):
    return view(spark, sf_dir, "told").select("id", rows.temporal_causality(F.col("told")).alias("causality"))


@_query("pattern_validity", f"""SELECT id, CASE WHEN body IS NULL THEN NULL ELSE coalesce(json_type(body, '$.pattern_type') = 'VARCHAR' AND json_type(body, '$.confidence_score') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_type(body, '$.detection_method') = 'VARCHAR' AND json_type(body, '$.pattern_data') = 'OBJECT'
 AND TRY_CAST(json_extract_string(body, '$.confidence_score') AS DOUBLE) BETWEEN 0 AND 1, false) END AS valid FROM {_JSONS}""")
def pattern_validity(spark, sf_dir):
    return view(spark, sf_dir, "pattern_bodies").select("id", rows.pattern_is_valid(F.col("body")).alias("valid"))


@_query("sheet_anomalies", f"""WITH c AS {_CELLS} SELECT file_id, CAST(sum(CAST(coalesce(regexp_matches(status, '#REF!|#VALUE!|#DIV/0!|#NAME!|#NUM!'), false) AS INT)) AS BIGINT) AS corrupted_cells, count(*) FILTER (status IS NULL) + count(*) FILTER (amount IS NULL) AS missing_values,
 count(*) - count(DISTINCT concat(coalesce('s' || status, ''), '|', amount)) AS duplicate_rows, count(*) FILTER (amount < 0) AS negative_amounts FROM c GROUP BY 1""")
def sheet_anomalies(spark, sf_dir):
    return ops.sheet_anomalies(view(spark, sf_dir, "cells"), "file_id", ["amount"])


_FIELDS = ", ".join(f"('{k}', '{f}')" for k, fields in rows.SHEET_FIELDS.items() for f in fields)


@_query("sheet_types", f"""WITH r AS {_HEADERS}, h AS (SELECT file_id, lower(trim(name)) AS name FROM r WHERE name <> 'nan'), n AS (SELECT file_id, count(*) FILTER (name <> 'nan') AS columns FROM r GROUP BY 1), k AS (SELECT * FROM (VALUES {_FIELDS}) AS t(kind, field)),
 hit AS (SELECT DISTINCT file_id, kind, field FROM h JOIN k ON contains(name, field)), s AS (SELECT file_id, count(*) FILTER (kind = 'profit_loss') AS p, count(*) FILTER (kind = 'balance_sheet') AS b, count(*) FILTER (kind = 'cashflow') AS c, string_agg(DISTINCT field, ',' ORDER BY field) AS indicators FROM hit GROUP BY 1)
 SELECT file_id, CASE WHEN p IS NULL THEN 'unknown' WHEN p >= b AND p >= c THEN 'profit_loss' WHEN b >= c THEN 'balance_sheet' ELSE 'cashflow' END AS sheet_type, CASE WHEN p IS NULL THEN 0.0 ELSE round(least(greatest(p, b, c) / columns, 1.0), 6) END AS confidence, coalesce(indicators, '') AS indicators FROM n LEFT JOIN s USING (file_id)""")
def sheet_types(spark, sf_dir):
    sheets = view(spark, sf_dir, "headers").groupBy("file_id").agg(F.collect_list("name").alias("names"))
    found = sheets.select("file_id", rows.sheet_type(F.col("names")).alias("s"))
    return found.select("file_id", "s.sheet_type", F.round("s.confidence", 6).alias("confidence"), F.array_join("s.indicators", ",").alias("indicators"))


_KIND = "CASE relationship_type WHEN 'invoice_to_next' THEN 'invoice_to_payment' WHEN 'payment_to_next' THEN 'expense_to_bank' ELSE 'transfer_to_next' END"


@_query("weighted_relationship_scores", f"""WITH {RELATIONSHIPS_SQL}, x AS (SELECT relationship_id, {_KIND} AS kind, CAST(a.amount_usd AS DOUBLE) AS p, CAST(b.amount_usd AS DOUBLE) AS q, abs(date_diff('day', CAST(a.source_ts AS DATE), CAST(b.source_ts AS DATE))) AS days, a.vendor_standard = b.vendor_standard AS same, a.priority = b.priority AS ids,
 list_distinct(string_split(lower(concat_ws(' ', a.document_type, a.category, a.source_platform)), ' ')) AS u, list_distinct(string_split(lower(concat_ws(' ', b.document_type, b.category, b.source_platform)), ' ')) AS v FROM relationships r JOIN ledger_events a ON r.source_event_id = a.event_id JOIN ledger_events b ON r.target_event_id = b.event_id),
 s AS (SELECT relationship_id, kind, CASE WHEN p = 0 OR q = 0 THEN 0.0 ELSE least(abs(p), abs(q)) / greatest(abs(p), abs(q)) END AS amount, CASE WHEN days = 0 THEN 1.0 WHEN days = 1 THEN 0.9 WHEN days <= 7 THEN 0.7 WHEN days <= 30 THEN 0.5 ELSE 0.2 END AS d, CAST(same AS INT) AS e, CAST(ids AS INT) AS i, len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))) AS c FROM x)
 SELECT relationship_id, round(CASE kind WHEN 'invoice_to_payment' THEN 0.4 ELSE 0.3 END * amount + CASE kind WHEN 'expense_to_bank' THEN 0.3 ELSE 0.2 END * d + 0.2 * e + CASE kind WHEN 'invoice_to_payment' THEN 0.3 ELSE 0.2 END * i + 0.1 * c, 6) AS score FROM s""")
def weighted_relationship_scores(spark, sf_dir):
    ledger = ledger_events(spark, sf_dir)
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "document_type", "category", "source_platform")), " "))
    side = lambda s: ledger.select(F.col("event_id").alias(f"{s}_event_id"), F.struct("amount_usd", F.to_date("source_ts").alias("day"), "vendor_standard", "priority", words.alias("words")).alias(s))
    joined = relationships(ledger).join(side("source"), "source_event_id").join(side("target"), "target_event_id")
    a, b = F.col("source"), F.col("target")
    same = lambda name: (a[name] == b[name]).cast("int")
    score = rows.weighted_score(
        F.expr(_KIND), amount=cleaning.compare_amounts(a["amount_usd"], b["amount_usd"]), date=cleaning.compare_dates(a["day"], b["day"]), entity=same("vendor_standard"), id=same("priority"), context=similarity.jaccard(a["words"], b["words"])
    )
    return joined.select("relationship_id", F.round(score, 6).alias("score"))


@_query("duplicate_decisions", f"""WITH f AS {_FILES}, d AS {_DECISIONS} SELECT file_id, user_id, file_hash, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.decision = 'replace' AND d.user_id = f.user_id AND d.file_hash = f.file_hash AND d.file_id <> f.file_id) THEN 'replaced' ELSE status END AS status FROM f""")
def duplicate_decisions(spark, sf_dir):
    return ops.decided(view(spark, sf_dir, "named_files"), view(spark, sf_dir, "decisions"))


@_query("corrected_entities", """WITH c AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey AS entity_id, round(coalesce(least(CAST(c_custkey % 100 AS DOUBLE) / 100 + n * 0.05, 1.0), CAST(c_custkey % 100 AS DOUBLE) / 100), 6) AS confidence_score, coalesce(n, 0) AS corrections FROM customer LEFT JOIN c ON c_custkey = id""")
def corrected_entities(spark, sf_dir):
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), ((F.col("c_custkey") % 100).cast("double") / 100).alias("confidence_score"))
    corrections = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("correct_entity_id"))
    return ops.corrected_entities(entities, corrections).withColumn("confidence_score", F.round("confidence_score", 6))


@_query("lineage_summaries", f"""WITH {LEDGER_SQL} SELECT event_id, CAST(2 + CAST(category <> 'transfer' AS INT) + CAST(confidence_score > 0.5 AS INT) AS INT) AS total_steps, concat('ingestion', CASE WHEN category <> 'transfer' THEN ',classification' ELSE '' END, ',enrichment', CASE WHEN confidence_score > 0.5 THEN ',entity_resolution' ELSE '' END) AS steps,
 CASE WHEN confidence_score > 0.5 THEN 120.0::DOUBLE ELSE 60.0::DOUBLE END AS duration_seconds, category <> 'transfer' AS has_ai_classification, true AS has_enrichment, confidence_score > 0.5 AS has_entity_resolution FROM ledger_events""")
def lineage_summaries(spark, sf_dir):
    at = F.col("source_ts").cast("timestamp")
    step = lambda name, seconds: F.struct(F.lit(name).alias("step"), (at + F.make_dt_interval(secs=F.lit(seconds))).alias("at"))
    path = F.array_compact(F.array(step("ingestion", 0), F.when(F.col("category") != "transfer", step("classification", 30)), step("enrichment", 60), F.when(F.col("confidence_score") > 0.5, step("entity_resolution", 120))))
    return ledger_events(spark, sf_dir).select("event_id", rows.lineage_summary(path).alias("s")).select("event_id", "s.*")


_FEATURES = [*rows.FEATURE_MINIMUMS, "reports"]


@_query("feature_access", f"""WITH {LEDGER_SQL}, n AS (SELECT user_id, count(*) AS n_events FROM ledger_events GROUP BY 1) SELECT user_id, feature, n_events >= least_events AS accessible FROM n,
 (VALUES ('causal_analysis', 30), ('temporal_forecasting', 50), ('relationship_mapping', 20), ('anomaly_detection', 10), ('reports', 0)) AS f(feature, least_events)""")
def feature_access(spark, sf_dir):
    users = ledger_events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    each = users.select("user_id", "n", F.explode(F.array(*map(F.lit, _FEATURES))).alias("feature"))
    return each.select("user_id", "feature", rows.feature_access(F.col("feature"), F.col("n")).alias("accessible"))


@_query("similar_part_names", r"""WITH p AS (SELECT DISTINCT p_brand, p_name, list_distinct(list_filter(string_split_regex(lower(p_name), '[\s,;]+'), lambda x: length(x) > 1)) AS t FROM part)
 SELECT a.p_brand, a.p_name AS name, b.p_name AS other, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_name < b.p_name WHERE list_has_any(a.t, b.t)""")
def similar_part_names(spark, sf_dir):
    """Pairs of different names of a brand that share a token, with the Jaccard similarity of their tokens."""
    names = table(spark, sf_dir, "part").select("p_brand", "p_name", cleaning.tokens(F.col("p_name")).alias("t")).distinct()
    held = names.select("p_brand", "p_name", F.explode("t").alias("token"))
    pairs = held.join(held.withColumnRenamed("p_name", "other"), ["p_brand", "token"]).where("p_name < other").select("p_brand", "p_name", "other").distinct()
    joined = pairs.join(names, ["p_brand", "p_name"]).join(names.toDF("p_brand", "other", "o"), ["p_brand", "other"])
    return joined.select("p_brand", F.col("p_name").alias("name"), "other", F.round(similarity.jaccard(F.col("t"), F.col("o")), 6).alias("similarity"))


@_query("minhash_name_pairs")
def minhash_name_pairs(spark, sf_dir):
    """Pairs of different names of a brand that agree in a band of two signature slots: estimated and exact similarity of their trigrams."""
    names = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct().withColumn("t", similarity.trigrams(F.col("p_name"))).withColumn("s", rules.minhash(F.col("t")))
    bands = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(i.alias("band"), F.slice(F.col("s"), 2 * i + 1, F.lit(2)).alias("value")))
    held = names.select("p_brand", "p_name", F.explode(bands).alias("b")).select("p_brand", "p_name", "b.*")
    pairs = held.join(held.withColumnRenamed("p_name", "other"), ["p_brand", "band", "value"]).where("p_name < other").select("p_brand", "p_name", "other").distinct()
    joined = pairs.join(names, ["p_brand", "p_name"]).join(names.toDF("p_brand", "other", "o", "r"), ["p_brand", "other"])
    return joined.select("p_brand", F.col("p_name").alias("name"), "other", F.round(rules.minhash_similarity(F.col("s"), F.col("r")), 4).alias("estimate"), F.round(similarity.jaccard(F.col("t"), F.col("o")), 4).alias("exact"))


@_query("text_entropy_bands", """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS k FROM c GROUP BY 1, 2), s AS (SELECT doc_id, k / sum(k) OVER (PARTITION BY doc_id) AS p FROM n), e AS (SELECT doc_id, -sum(p * log2(p)) AS h FROM s GROUP BY 1)
 SELECT bits_per_char, count(*) AS n FROM (SELECT round(coalesce(h, 0.0), 1) + 0.0 AS bits_per_char FROM documents LEFT JOIN e USING (doc_id)) GROUP BY 1""")
def text_entropy_bands(spark, sf_dir):
    """Documents by the entropy of their whole texts; 0 for empty and missing ones."""
    bits = F.round(F.coalesce(rows.character_entropy(F.col("text")), F.lit(0.0)), 1) + 0.0
    return table(spark, sf_dir, "documents").groupBy(bits.alias("bits_per_char")).agg(F.count("*").alias("n"))


# These names stand for the queries that compare different values and read whole ones.
QUERIES["token_jaccard_names"], SQL["token_jaccard_names"] = QUERIES["similar_part_names"], SQL["similar_part_names"]
QUERIES["document_entropy_bands"], SQL["document_entropy_bands"] = QUERIES["text_entropy_bands"], SQL["text_entropy_bands"]
QUERIES["minhash_pairs"] = QUERIES["minhash_name_pairs"]
