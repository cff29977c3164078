"""Queries over the wider records, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as ops
from ..operators import checks, relations
from ..sources.adapters import LEDGER_SQL, RELATIONSHIPS_SQL, entity_edges, ledger_events, relationships, table
from ..sources.adapters import EDGES_SQL
from ..sources.records import ctes, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "2001-08-01"


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


# ---- search

@_query("search_by_document_type", f"WITH {ctes('records')} SELECT event_id, category, document_type, document_confidence, source_platform, CAST(amount_usd AS DOUBLE) AS amount_usd, vendor_standard FROM records WHERE user_id = 7 AND document_type = 'invoice' AND coalesce(document_confidence, 0) >= 0.5")
def search_by_document_type(spark, sf_dir):
    found = ops.by_document_type(view(spark, sf_dir, "records"), 7, "invoice", 0.5)
    return found.select("event_id", "category", "document_type", "document_confidence", "source_platform", F.col("amount_usd").cast("double").alias("amount_usd"), "vendor_standard")


@_query("search_by_entity", f"WITH {ctes('records')} SELECT event_id, user_id, category, source_platform FROM records WHERE employee = 'clerk 7'")
def search_by_entity(spark, sf_dir):
    found = ops.by_entity(_with_entities(view(spark, sf_dir, "records")), "employees", "clerk 7")
    return found.select("event_id", "user_id", "category", "source_platform")


def _with_entities(records: DataFrame) -> DataFrame:
    lists = {"employees": "employee", "vendors": "vendor_standard", "projects": "project"}
    return records.withColumn("entities", F.create_map(*(x for k, c in lists.items() for x in (F.lit(k), F.array_compact(F.array(c))))))


@_query("search_by_vendor", f"WITH {ctes('records')} SELECT event_id, user_id, category, CAST(amount_usd AS DOUBLE) AS amount_usd, currency, vendor_standard FROM records WHERE vendor_standard ILIKE '%00012%'")
def search_by_vendor(spark, sf_dir):
    return ops.by_vendor(view(spark, sf_dir, "records"), "00012").select("event_id", "user_id", "category", F.col("amount_usd").cast("double").alias("amount_usd"), "currency", "vendor_standard")


@_query("search_normalized_events", f"WITH {ctes('normalized')} SELECT id, user_id, document_type, platform_label, confidence, requires_review FROM normalized WHERE normalized_payload ILIKE '%5%' AND document_type = 'click' AND platform_label = 'stripe' AND (confidence IS NULL OR confidence >= 0.4)")
def search_normalized_events(spark, sf_dir):
    found = ops.normalized_events(view(spark, sf_dir, "normalized"), "5", "click", "stripe", 0.4)
    return found.select("id", "user_id", "document_type", "platform_label", "confidence", "requires_review")


_LINKED = f"WITH {RELATIONSHIPS_SQL}, {ctes('linked')}"


@_query("search_relationships", f"{_LINKED} SELECT relationship_id, source_event_id, target_event_id, relationship_type, confidence_score, detection_method FROM linked WHERE reasoning ILIKE '%INVOICE%' AND relationship_type = 'invoice_to_next' AND confidence_score >= 0.8")
def search_relationships(spark, sf_dir):
    found = ops.relationships_by(view(spark, sf_dir, "linked"), "INVOICE", "invoice_to_next", 0.8)
    return found.select("relationship_id", "source_event_id", "target_event_id", "relationship_type", "confidence_score", "detection_method")


@_query("user_field_mappings", f"WITH {ctes('mappings')} SELECT id, user_id, source_column, target_field, platform, confidence, usage_count, success_count FROM mappings WHERE platform = 'platform1' OR platform IS NULL")
def user_field_mappings(spark, sf_dir):
    return ops.field_mappings(view(spark, sf_dir, "mappings"), "platform1").select("id", "user_id", "source_column", "target_field", "platform", "confidence", "usage_count", "success_count")


@_query("mapping_successes", f"WITH {ctes('mappings')} SELECT m.id, m.usage_count, m.success_count + coalesce(u.n, 0) AS success_count FROM mappings m LEFT JOIN (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1) u ON m.id = u.id")
def mapping_successes(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    return ops.mapping_successes(view(spark, sf_dir, "mappings"), used).select("id", "usage_count", "success_count")


@_query("platform_patterns", f"WITH {ctes('platform_patterns')} SELECT user_id, platform, patterns, strftime(updated_at, '%Y-%m-%d') AS updated FROM platform_patterns")
def platform_patterns(spark, sf_dir):
    return view(spark, sf_dir, "platform_patterns").select("user_id", "platform", "patterns", _day("updated_at").alias("updated"))


@_query("platform_patterns_structured", f"WITH {ctes('platform_patterns')} SELECT user_id, platform, patterns->>'pattern_type' AS pattern_type, CAST(CAST(patterns->>'confidence_score' AS DECIMAL(3,2)) AS DOUBLE) AS confidence_score, patterns->>'detection_method' AS detection_method, CAST(patterns->'pattern_data' AS VARCHAR) AS pattern_data, strftime(updated_at, '%Y-%m-%d') AS updated FROM platform_patterns")
def platform_patterns_structured(spark, sf_dir):
    found = ops.structured_patterns(view(spark, sf_dir, "platform_patterns"))
    return found.select("user_id", "platform", "pattern_type", F.col("confidence_score").cast("double").alias("confidence_score"), "detection_method", "pattern_data", _day("updated_at").alias("updated"))


@_query("discovered_platform_list", f"WITH {ctes('discovered')} SELECT user_id, platform_name, discovery_reason, confidence_score, strftime(discovered_at, '%Y-%m-%d') AS discovered FROM discovered")
def discovered_platform_list(spark, sf_dir):
    return view(spark, sf_dir, "discovered").select("user_id", "platform_name", "discovery_reason", "confidence_score", _day("discovered_at").alias("discovered"))


@_query("user_metrics_newest", f"WITH {LEDGER_SQL} SELECT user_id, event_id, strftime(source_ts, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source_ts DESC, event_id) AS n FROM ledger_events WHERE source_ts >= TIMESTAMP '1996-01-01' AND source_ts < TIMESTAMP '1999-01-01') WHERE n <= 100")
def user_metrics_newest(spark, sf_dir):
    """The newest 100 of each user within a range of dates."""
    within = ledger_events(spark, sf_dir).where("source_ts >= TIMESTAMP '1996-01-01' AND source_ts < TIMESTAMP '1999-01-01'")
    return _newest(within, 100).select("user_id", "event_id", _day("source_ts").alias("day"))


def _newest(events: DataFrame, n: int) -> DataFrame:
    from ..operators.search import latest_per_key

    return latest_per_key(events, "user_id", [F.desc("source_ts"), F.col("event_id")], n)


@_query("recent_events", f"WITH {LEDGER_SQL} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source_ts DESC, event_id) AS n FROM ledger_events) WHERE n <= 10")
def recent_events(spark, sf_dir):
    return _newest(ledger_events(spark, sf_dir), 10).select("user_id", "event_id")


@_query("entities_by_type", f"WITH {ctes('entity_table')} SELECT user_id, entity_id, canonical_name, strftime(last_seen, '%Y-%m-%d') AS seen FROM entity_table WHERE entity_type = 'vendor'")
def entities_by_type(spark, sf_dir):
    return view(spark, sf_dir, "entity_table").where("entity_type = 'vendor'").select("user_id", "entity_id", "canonical_name", _day("last_seen").alias("seen"))


@_query("platforms_of_users", f"WITH {ctes('records')} SELECT DISTINCT user_id, source_platform FROM records WHERE source_platform IS NOT NULL")
def platforms_of_users(spark, sf_dir):
    return view(spark, sf_dir, "records").where("source_platform IS NOT NULL").select("user_id", "source_platform").distinct()


@_query("events_for_extraction", f"WITH {ctes('records')} SELECT event_id, file_id, vendor_raw, document_type FROM records WHERE user_id = 3 AND status <> 'failed'")
def events_for_extraction(spark, sf_dir):
    return view(spark, sf_dir, "records").where("user_id = 3 AND status <> 'failed'").select("event_id", "file_id", "vendor_raw", "document_type")


@_query("component_results_newest", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 100")
def component_results_newest(spark, sf_dir):
    from ..operators.search import latest_per_key

    return latest_per_key(table(spark, sf_dir, "events"), "event_type", [F.desc("ts"), F.col("event_id")], 100).select("event_type", "event_id")


@_query("entities_by_name_or_alias", f"WITH {ctes('entity_table')} SELECT entity_id, canonical_name, CASE WHEN canonical_name ILIKE 'customer 000000012' OR alias ILIKE 'customer 000000012' THEN 1.0 ELSE 0.8 END::DOUBLE AS score FROM entity_table WHERE canonical_name ILIKE '%customer 000000012%' OR alias ILIKE '%customer 000000012%'")
def entities_by_name_or_alias(spark, sf_dir):
    """1 where the name or an alias is the term, .8 where one holds it."""
    term, names = "customer 000000012", [F.lower("canonical_name"), F.lower("alias")]
    hit = F.when((names[0] == term) | (names[1] == term), 1.0).when(F.contains(names[0], F.lit(term)) | F.contains(names[1], F.lit(term)), 0.8)
    return view(spark, sf_dir, "entity_table").select("entity_id", "canonical_name", hit.alias("score")).where("score IS NOT NULL")


# ---- statistics

@_query("entity_name_stats", f"""WITH {ctes('records')}, n AS (SELECT DISTINCT user_id, 'e' AS k, employee AS name FROM records UNION SELECT DISTINCT user_id, 'v', vendor_standard FROM records UNION SELECT DISTINCT user_id, 'p', project FROM records)
 SELECT user_id, count(name) FILTER (k='e') AS total_employees, count(name) FILTER (k='v') AS total_vendors, CAST(0 AS BIGINT) AS total_customers, count(name) FILTER (k='p') AS total_projects,
 coalesce(string_agg(name, ',' ORDER BY name) FILTER (k='e'), '') AS employee_names, coalesce(string_agg(name, ',' ORDER BY name) FILTER (k='v'), '') AS vendor_names, '' AS customer_names, coalesce(string_agg(name, ',' ORDER BY name) FILTER (k='p'), '') AS project_names FROM n WHERE name IS NOT NULL GROUP BY 1""")
def entity_name_stats(spark, sf_dir):
    return ops.entity_stats(_with_entities(view(spark, sf_dir, "records")))


def _counted(source: str, value: str, name: str) -> str:
    return f"(SELECT user_id, string_agg(v || ':' || n, ',' ORDER BY v || ':' || n) AS {name} FROM (SELECT user_id, {value} AS v, count(*) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"


def _mean(value: str) -> str:
    return f"round(CAST(sum(CAST({value} AS DECIMAL(18,6))) AS DOUBLE) / count({value}), 3)"


@_query("enrichment_stats", f"""WITH {ctes('records')}, s AS (SELECT user_id, count(*) AS total_events, count(*) FILTER (amount_usd <> amount_original) AS events_with_currency_conversion, count(*) FILTER (vendor_standard <> vendor_raw) AS events_with_vendor_standardization, count(platform_id) AS events_with_platform_ids,
 CAST(coalesce(sum(amount_usd), 0) AS DOUBLE) AS total_amount_usd, round(avg(vendor_confidence), 6) AS vendor_standardization_accuracy, round(avg(exchange_rate), 6) AS avg_exchange_rate FROM records GROUP BY 1)
 SELECT s.*, currency_breakdown FROM s LEFT JOIN {_counted('records', 'currency', 'currency_breakdown')} c USING (user_id)""")
def enrichment_stats(spark, sf_dir):
    return ops.enrichment_stats(view(spark, sf_dir, "records"))


_SIGNED = "CASE transaction_type WHEN 'income' THEN amount_usd WHEN 'expense' THEN -amount_usd ELSE 0 END"


@_query("accuracy_stats_full", f"""WITH {ctes('records')} SELECT user_id, count(*) AS total_events, count(*) FILTER (accuracy_enhanced) AS accuracy_enhanced_events, count(*) FILTER (requires_review) AS events_requiring_review, count(*) FILTER (review_priority = 'high') AS high_priority_reviews,
 count(*) FILTER (transaction_type = 'income') AS income_events, count(*) FILTER (transaction_type = 'expense') AS expense_events, count(*) FILTER (transaction_type = 'transfer') AS transfer_events,
 CAST(coalesce(sum({_SIGNED}) FILTER (transaction_type = 'income'), 0) AS DOUBLE) AS total_income_usd, CAST(coalesce(abs(sum({_SIGNED}) FILTER (transaction_type = 'expense')), 0) AS DOUBLE) AS total_expenses_usd,
 CAST(coalesce(sum({_SIGNED}) FILTER (transaction_type <> 'transfer'), 0) AS DOUBLE) AS net_cash_flow_usd, round(avg(document_confidence), 6) AS avg_overall_confidence, round(count(*) FILTER (NOT is_valid) / count(*), 6) AS validation_error_rate FROM records GROUP BY 1""")
def accuracy_stats_full(spark, sf_dir):
    kind, usd = F.col("transaction_type"), F.col("amount_usd")
    signed = F.when(kind == "income", usd).when(kind == "expense", -usd).otherwise(F.lit(0).cast("decimal(15,2)"))
    return ops.accuracy_stats(view(spark, sf_dir, "records").withColumn("amount_signed_usd", signed).withColumn("affects_cash", kind != "transfer"))


@_query("events_for_review", f"WITH {ctes('records')} SELECT event_id, user_id, review_priority, CASE review_priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS priority_rank FROM records WHERE requires_review")
def events_for_review(spark, sf_dir):
    return ops.review_queue(view(spark, sf_dir, "records")).select("event_id", "user_id", "review_priority", "priority_rank")


@_query("platform_stats", f"""WITH {ctes('platform_patterns', 'discovered')} SELECT p.user_id, count(DISTINCT platform) AS total_platforms, count(DISTINCT platform) AS learned_platforms, count(DISTINCT platform_name) AS discovered_platforms,
 (SELECT platform FROM platform_patterns x WHERE x.user_id = p.user_id ORDER BY updated_at DESC, platform DESC LIMIT 1) AS most_used_platform, strftime(max(discovered_at), '%Y-%m-%d') AS latest_discovery FROM platform_patterns p LEFT JOIN discovered d ON d.user_id = p.user_id GROUP BY p.user_id""")
def platform_stats(spark, sf_dir):
    return ops.platform_stats(view(spark, sf_dir, "platform_patterns"), view(spark, sf_dir, "discovered"))


@_query("normalization_stats", f"""WITH {ctes('normalized')}, s AS (SELECT user_id, count(*) AS total_normalized, round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (requires_review) AS requires_review_count, count(DISTINCT duplicate_group_id) AS duplicate_groups FROM normalized GROUP BY 1)
 SELECT s.*, by_document_type, by_platform FROM s LEFT JOIN {_counted('normalized', 'document_type', 'by_document_type')} a USING (user_id) LEFT JOIN {_counted('normalized', 'platform_label', 'by_platform')} b USING (user_id)""")
def normalization_stats(spark, sf_dir):
    return ops.normalization_stats(view(spark, sf_dir, "normalized"))


@_query("entity_resolution_stats", f"""WITH {ctes('entity_table', 'matches')}, e AS (SELECT user_id, count(*) AS total_entities, count(*) FILTER (entity_type='employee') AS employees_count, count(*) FILTER (entity_type='vendor') AS vendors_count, count(*) FILTER (entity_type='customer') AS customers_count, count(*) FILTER (entity_type='project') AS projects_count FROM entity_table GROUP BY 1),
 m AS (SELECT user_id, count(*) AS total_matches, count(*) FILTER (match_method='exact_name') AS exact_matches, count(*) FILTER (match_method='fuzzy_name') AS fuzzy_matches, count(*) FILTER (match_method='email') AS email_matches, count(*) FILTER (match_method='bank_account') AS bank_matches, count(*) FILTER (match_method='new_entity') AS new_entities, round(avg(confidence), 6) AS avg_confidence FROM matches GROUP BY 1)
 SELECT * FROM e LEFT JOIN m USING (user_id)""")
def entity_resolution_stats(spark, sf_dir):
    return ops.resolution_stats(view(spark, sf_dir, "entity_table"), view(spark, sf_dir, "matches"))


@_query("semantic_relationship_stats", f"""{_LINKED}, s AS (SELECT user_id, count(*) AS total_relationships, count(semantic_description) AS with_semantics, round(100.0 * count(semantic_description) / count(*), 2)::DOUBLE AS semantic_coverage_percent, {_mean('confidence_score')} AS avg_confidence,
 count(*) FILTER (temporal_causality IN ('source_causes_target','target_causes_source','bidirectional')) AS causal_relationships, count(*) FILTER (temporal_causality = 'correlation_only') AS correlation_only FROM linked GROUP BY 1)
 SELECT s.*, causality_distribution, logic_distribution FROM s LEFT JOIN {_counted('linked', 'temporal_causality', 'causality_distribution')} a USING (user_id) LEFT JOIN {_counted('linked', 'business_logic', 'logic_distribution')} b USING (user_id)""")
def semantic_relationship_stats(spark, sf_dir):
    return ops.semantic_stats(view(spark, sf_dir, "linked"))


def _transactions(spark, sf_dir) -> DataFrame:
    """With an end in the column of its status."""
    held = view(spark, sf_dir, "transactions")
    end = F.col("started_at") + F.make_dt_interval(secs=F.col("seconds"))
    for status in ("committed", "rolled_back", "failed"):
        held = held.withColumn(f"{status}_at", F.when(F.col("status") == status, end))
    return held


@_query("transaction_stats", f"""WITH {ctes('transactions')} SELECT user_id, count(*) AS total_transactions, count(*) FILTER (status='active') AS active_transactions, count(*) FILTER (status='committed') AS committed_transactions, count(*) FILTER (status='rolled_back') AS rolled_back_transactions, count(*) FILTER (status='failed') AS failed_transactions,
 round(avg(CASE WHEN status <> 'active' THEN CAST(seconds AS DOUBLE) END), 4) AS avg_processing_time_seconds FROM transactions GROUP BY 1""")
def transaction_stats(spark, sf_dir):
    return ops.transaction_stats(_transactions(spark, sf_dir))


@_query("transaction_times", f"WITH {ctes('transactions')} SELECT id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(CASE WHEN status <> 'active' THEN started_at + to_seconds(seconds) END, '%Y-%m-%d %H:%M:%S') AS end_time FROM transactions")
def transaction_times(spark, sf_dir):
    found = ops.with_end_times(_transactions(spark, sf_dir), _as_of())
    return found.select("id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start_time", "end_time")))


@_query("transaction_dates", "SELECT o_orderkey AS event_id, strftime(CASE WHEN o_orderkey % 3 = 0 THEN DATE '1990-01-01' ELSE CAST(o_orderdate AS DATE) END, '%Y-%m-%d') AS day FROM orders")
def transaction_dates(spark, sf_dir):
    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("source_ts"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("1990-01-01").cast("date")).alias("transaction_date"))
    return ops.with_transaction_date(held).select("event_id", _day("transaction_date").alias("day"))


@_query("old_transactions", f"WITH {ctes('transactions')} SELECT id, status FROM transactions WHERE started_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND status IN ('committed','rolled_back','failed')")
def old_transactions(spark, sf_dir):
    return ops.finished_before(_transactions(spark, sf_dir), _as_of(), 30).select("id", "status")


@_query("committed_without_rows", f"WITH {ctes('transactions')} SELECT id, user_id FROM transactions t WHERE status='committed' AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = t.id) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = t.id AND l.l_quantity > 25)")
def committed_without_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("id"))
    return ops.committed_without_rows(view(spark, sf_dir, "transactions"), events, rows).select("id", "user_id")


@_query("user_statistics", f"""WITH {RELATIONSHIPS_SQL}, {ctes('entity_table')}, f AS (SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, file_id FROM ledger_events) GROUP BY 1), k AS (SELECT user_id FROM ledger_events UNION SELECT user_id FROM entity_table UNION SELECT user_id FROM relationships)
 SELECT k.user_id, (SELECT count(*) FROM ledger_events x WHERE x.user_id=k.user_id) AS events, coalesce(f.n, 0) AS files, (SELECT count(*) FROM entity_table x WHERE x.user_id=k.user_id) AS entities, (SELECT count(*) FROM relationships x WHERE x.user_id=k.user_id) AS relationships FROM k LEFT JOIN f ON f.user_id=k.user_id""")
def user_statistics(spark, sf_dir):
    ledger = ledger_events(spark, sf_dir)
    return ops.user_counts(events=ledger, files=ledger.select("user_id", "file_id").distinct(), entities=view(spark, sf_dir, "entity_table"), relationships=relationships(ledger))


@_query("financial_summary", f"""WITH {ctes('records')}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source_ts DESC, event_id) AS n FROM records WHERE source_ts <= TIMESTAMP '{AS_OF}' AND source_ts > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY),
 s AS (SELECT user_id, count(*) AS n_events, CAST(coalesce(sum(CASE WHEN category='revenue' THEN abs(amount_usd) END), 0) AS DOUBLE) AS revenue, CAST(coalesce(sum(CASE WHEN category='expense' THEN abs(amount_usd) END), 0) AS DOUBLE) AS expenses FROM r WHERE n <= 1000 GROUP BY 1)
 SELECT *, round(revenue - expenses, 2) AS net, round(CASE WHEN revenue > 0 THEN 100 * (revenue - expenses) / revenue ELSE 0.0 END, 4) AS margin FROM s""")
def financial_summary(spark, sf_dir):
    return ops.financial_summary(view(spark, sf_dir, "records"), _as_of())


# ---- causal paths and graph

_PATHS = f"""WITH RECURSIVE {RELATIONSHIPS_SQL}, e AS (SELECT relationship_id AS id, source_event_id AS src, target_event_id AS dst, confidence_score AS score FROM relationships WHERE temporal_causality IN ('source_causes_target', 'bidirectional')),
 p AS (SELECT 1 AS depth, [src, dst] AS path, [id] AS links, score AS confidence FROM e UNION ALL SELECT p.depth + 1, list_append(p.path, e.dst), list_append(p.links, e.id), p.confidence * e.score FROM p JOIN e ON e.src = p.path[-1] WHERE p.depth < 5 AND NOT list_contains(p.path, e.dst))"""


def _causal_edges(spark, sf_dir) -> DataFrame:
    links = relationships(ledger_events(spark, sf_dir)).where("temporal_causality IN ('source_causes_target', 'bidirectional')")
    return links.select(F.col("relationship_id").alias("id"), F.col("source_event_id").alias("src"), F.col("target_event_id").alias("dst"), F.col("confidence_score").alias("score"))


def _joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ">").alias(column)


@_query("causal_paths", f"{_PATHS} SELECT depth, array_to_string(path, '>') AS path, array_to_string(links, '>') AS links, round(confidence, 9) AS confidence FROM p")
def causal_paths(spark, sf_dir):
    return ops.causal_paths(_causal_edges(spark, sf_dir), 5).select("depth", _joined("path"), _joined("links"), F.round("confidence", 9).alias("confidence"))


@_query("root_cause_paths", f"""WITH RECURSIVE {RELATIONSHIPS_SQL}, e AS (SELECT source_event_id AS src, target_event_id AS dst, confidence_score AS score FROM relationships WHERE temporal_causality IN ('source_causes_target', 'bidirectional')),
 p AS (SELECT src AS now, dst AS problem, [dst, src] AS path, 1 AS depth, score FROM e UNION ALL SELECT e.src, p.problem, list_append(p.path, e.src), p.depth + 1, p.score * e.score FROM p JOIN e ON e.dst = p.now WHERE p.depth < 10 AND NOT list_contains(p.path, e.src))
 SELECT now AS root, problem, array_to_string(path, '>') AS path, depth, round(score, 9) AS score FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.dst = p.now)""")
def root_cause_paths(spark, sf_dir):
    return ops.root_paths(_causal_edges(spark, sf_dir), 10).select("root", "problem", _joined("path"), "depth", F.round("score", 9).alias("score"))


def _scored(spark, sf_dir) -> DataFrame:
    ledger = ledger_events(spark, sf_dir)
    links = relationships(ledger)
    return relations.bradford_hill(links, ledger).join(links.select("relationship_id", "user_id", "temporal_causality"), "relationship_id")


_HILL = f"""{RELATIONSHIPS_SQL}, alike AS (SELECT user_id, relationship_type, count(*) FILTER (confidence_score >= 0.7) AS n FROM relationships GROUP BY 1, 2),
 outs AS (SELECT user_id, source_event_id, count(*) AS n FROM relationships GROUP BY 1, 2), ins AS (SELECT user_id, target_event_id, count(*) AS n FROM relationships GROUP BY 1, 2), boths AS (SELECT user_id, source_event_id, target_event_id, count(*) AS n FROM relationships GROUP BY 1, 2, 3),
 hill AS (SELECT r.*, CASE WHEN d > 0 THEN least(1.0, d / 90.0) ELSE 0.0 END::DOUBLE AS temporal, r.confidence_score AS strength, least(1.0, alike.n / 10.0)::DOUBLE AS consistency,
  CASE WHEN edges = 1 THEN 1.0 WHEN edges <= 3 THEN 0.7 ELSE 0.3 END::DOUBLE AS specificity,
  CASE WHEN a.amount_usd > 0 THEN greatest(0.0, 1 - abs(CAST(a.amount_usd AS DOUBLE) - CAST(b.amount_usd AS DOUBLE)) / greatest(CAST(a.amount_usd AS DOUBLE), CAST(b.amount_usd AS DOUBLE))) ELSE 0.0 END::DOUBLE AS dose,
  CASE r.temporal_causality WHEN 'source_causes_target' THEN 1.0 WHEN 'bidirectional' THEN 0.8 WHEN 'target_causes_source' THEN 0.3 ELSE 0.5 END::DOUBLE AS plausibility
  FROM relationships r JOIN ledger_events a ON r.source_event_id = a.event_id JOIN ledger_events b ON r.target_event_id = b.event_id JOIN alike ON alike.user_id = r.user_id AND alike.relationship_type = r.relationship_type JOIN outs o ON o.user_id = r.user_id AND o.source_event_id = r.source_event_id JOIN ins i ON i.user_id = r.user_id AND i.target_event_id = r.target_event_id
  JOIN boths x ON x.user_id = r.user_id AND x.source_event_id = r.source_event_id AND x.target_event_id = r.target_event_id, LATERAL (SELECT date_diff('day', CAST(a.source_ts AS DATE), CAST(b.source_ts AS DATE)) AS d, o.n + i.n - x.n AS edges))"""
_HILL_SCORES = ", ".join(f"round({c}, 6) AS {c}" for c in ("temporal", "strength", "consistency", "specificity", "dose", "plausibility")) + ", round((temporal + strength + consistency + specificity + dose + plausibility) / 6, 6) AS causal_score"


@_query("causal_analysis", f"WITH {_HILL} SELECT relationship_id, causal_score, causal_score >= 0.7 AS is_causal, CASE WHEN temporal < 0.7 THEN 'none' WHEN temporal_causality = 'target_causes_source' THEN 'target_to_source' WHEN temporal_causality = 'bidirectional' THEN 'bidirectional' ELSE 'source_to_target' END AS direction FROM (SELECT relationship_id, temporal_causality, {_HILL_SCORES} FROM hill)")
def causal_analysis(spark, sf_dir):
    return _scored(spark, sf_dir).select("relationship_id", "causal_score", (F.col("causal_score") >= 0.7).alias("is_causal"), ops.causal_direction(F.col("temporal"), F.col("temporal_causality")).alias("direction"))


@_query("causal_graph_stats", f"""WITH {_HILL}, s AS (SELECT user_id, temporal_causality, {_HILL_SCORES} FROM hill), d AS (SELECT *, causal_score >= 0.7 AS causal, CASE WHEN temporal < 0.7 THEN 'none' WHEN temporal_causality = 'target_causes_source' THEN 'target_to_source' WHEN temporal_causality = 'bidirectional' THEN 'bidirectional' ELSE 'source_to_target' END AS direction FROM s)
 SELECT t.*, directions FROM (SELECT user_id, count(*) AS total_relationships, count(*) FILTER (causal) AS causal_relationships, round(100.0 * count(*) FILTER (causal) / count(*), 2)::DOUBLE AS causal_percentage, {_mean('causal_score')} AS avg_causal_score, {', '.join(f"{_mean(f'CASE WHEN causal THEN {c} END')} AS avg_{c}" for c in ('temporal', 'strength', 'consistency', 'specificity', 'dose', 'plausibility'))} FROM d GROUP BY 1) t
 LEFT JOIN {_counted('(SELECT * FROM d WHERE causal)', 'direction', 'directions')} c USING (user_id)""")
def causal_graph_stats(spark, sf_dir):
    return ops.causal_stats(_scored(spark, sf_dir))


@_query("graph_paths", f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT src, dst, CAST(n_lines % 10 AS DOUBLE) / 10 AS causal, CAST(n_lines % 7 AS DOUBLE) / 7 AS confidence FROM entity_edges),
 p AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS hops, [CAST(0 AS BIGINT)] AS path, 0.0::DOUBLE AS causal, 0.0::DOUBLE AS confidence UNION ALL SELECT e.dst, p.hops + 1, list_append(p.path, e.dst), p.causal + e.causal, p.confidence + e.confidence FROM p JOIN e ON p.node = e.src WHERE p.hops < 3 AND NOT list_contains(p.path, e.dst)),
 r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, path) AS n FROM p WHERE hops > 0) SELECT node, hops, array_to_string(path, '>') AS path, round(causal, 6) AS causal_sum, round(confidence / hops, 6) AS avg_confidence FROM r WHERE n = 1""")
def graph_paths(spark, sf_dir):
    edges = entity_edges(spark, sf_dir).select("src", "dst", ((F.col("n_lines") % 10).cast("double") / 10).alias("causal"), ((F.col("n_lines") % 7).cast("double") / 7).alias("confidence"))
    return ops.best_paths(edges, 0, 3).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


# ---- duplicates and entities

@_query("duplicate_cascade", """WITH f AS (SELECT p_partkey AS file_id, p_partkey % 5 AS user_id, CASE WHEN p_partkey % 4 = 0 THEN sha256(p_brand || p_size) END AS file_hash, sha256(p_type || p_size) AS content_hash, list_sort(list_distinct(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' '))) AS tokens FROM part),
 c AS (SELECT b.file_id, 1 AS phase, 'exact' AS t, min(a.file_id) AS original, 1.0::DOUBLE AS s FROM f a JOIN f b ON a.user_id=b.user_id AND a.file_hash=b.file_hash AND a.file_id<b.file_id GROUP BY 1
  UNION ALL SELECT file_id, 2, 'near', original, s FROM (SELECT b.file_id, a.file_id AS original, len(list_intersect(a.tokens,b.tokens))::DOUBLE / len(list_distinct(list_concat(a.tokens,b.tokens))) AS s, row_number() OVER (PARTITION BY b.file_id ORDER BY len(list_intersect(a.tokens,b.tokens))::DOUBLE / len(list_distinct(list_concat(a.tokens,b.tokens))) DESC, a.file_id) AS n FROM f a JOIN f b ON a.user_id=b.user_id AND a.file_id<b.file_id WHERE len(list_intersect(a.tokens,b.tokens))::DOUBLE / len(list_distinct(list_concat(a.tokens,b.tokens))) >= 0.6) WHERE n=1
  UNION ALL SELECT b.file_id, 3, 'content', min(a.file_id), 1.0 FROM f a JOIN f b ON a.user_id=b.user_id AND a.content_hash=b.content_hash AND a.file_id<b.file_id GROUP BY 1)
 SELECT f.file_id, coalesce(t, 'none') AS duplicate_type, original, round(coalesce(s, 0.0), 6) AS similarity FROM f LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY phase) = 1) x USING (file_id)""")
def duplicate_cascade(spark, sf_dir):
    key, words = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_type", "p_brand")
    size = F.col("p_size").cast("string")
    files = table(spark, sf_dir, "part").select(key.alias("file_id"), (key % 5).alias("user_id"), F.when(key % 4 == 0, F.sha2(F.concat("p_brand", size), 256)).alias("file_hash"), F.sha2(F.concat("p_type", size), 256).alias("content_hash"), F.array_distinct(F.split(words, " ")).alias("tokens"))
    return ops.duplicate_cascade(files, 0.6)


@_query("entity_cascade", """WITH g(x) AS (SELECT 1), k AS (SELECT c_custkey AS entity_id, c_custkey % 25 AS user_id, c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN 'm' || c_custkey || '@x.org' END AS email FROM customer),
 m AS (SELECT c_custkey AS id, c_custkey % 25 AS user_id, CASE c_custkey % 4 WHEN 0 THEN ' ' || upper(c_name) WHEN 1 THEN c_name || ' ltd' WHEN 2 THEN c_name ELSE 'nobody ' || c_custkey END AS name, CASE WHEN c_custkey % 6 = 0 THEN 'M' || c_custkey || '@x.org' END AS email FROM customer),
 mm AS (SELECT m.*, lower(trim(name)) AS folded, (SELECT min(entity_id) FROM k WHERE k.user_id=m.user_id AND lower(k.email)=lower(m.email)) AS by_mail, (SELECT min(entity_id) FROM k WHERE k.user_id=m.user_id AND lower(trim(k.name))=lower(trim(m.name))) AS by_name FROM m),
 t AS (SELECT mm.id, k.entity_id, list_distinct(list_transform(range(1, greatest(length(folded)-2,1)+1), lambda i: substring(folded, i, 3))) AS a, list_distinct(list_transform(range(1, greatest(length(k.name)-2,1)+1), lambda i: substring(lower(trim(k.name)), i, 3))) AS b FROM mm JOIN k ON k.user_id=mm.user_id WHERE by_mail IS NULL AND by_name IS NULL),
 u AS (SELECT id, entity_id, len(list_intersect(a,b))::DOUBLE / len(list_distinct(list_concat(a,b))) AS s FROM t),
 v AS (SELECT * FROM u WHERE s >= 0.75 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, entity_id) = 1)
 SELECT mm.id, coalesce(by_mail, by_name, v.entity_id) AS entity_id, CASE WHEN by_mail IS NOT NULL THEN 'email' WHEN by_name IS NOT NULL THEN 'exact_name' WHEN v.entity_id IS NOT NULL THEN 'fuzzy_name' ELSE 'new' END AS method,
 CASE WHEN by_mail IS NOT NULL THEN 0.95 WHEN by_name IS NOT NULL THEN 1.0 ELSE coalesce(round(s, 6), 0.0) END::DOUBLE AS confidence, round(1 - CASE WHEN by_mail IS NOT NULL THEN 0.95 WHEN by_name IS NOT NULL THEN 1.0 ELSE coalesce(round(s, 6), 0.0) END, 6)::DOUBLE AS entropy FROM mm LEFT JOIN v USING (id)""")
def entity_cascade(spark, sf_dir):
    """Mentions of all customers, some misspelt or unknown, against all of them."""
    c = table(spark, sf_dir, "customer")
    key, name = F.col("c_custkey"), F.col("c_name")
    mail = lambda first: F.when(key % 6 == 0, F.concat(F.lit(first), key.cast("string"), F.lit("@x.org")))
    known = c.select(key.alias("entity_id"), (key % 25).alias("user_id"), name.alias("name"), mail("m").alias("email"))
    said = F.when(key % 4 == 0, F.concat(F.lit(" "), F.upper(name))).when(key % 4 == 1, F.concat(name, F.lit(" ltd"))).when(key % 4 == 2, name).otherwise(F.concat(F.lit("nobody "), key.cast("string")))
    return ops.resolve_entities(c.select(key.alias("id"), (key % 25).alias("user_id"), said.alias("name"), mail("M").alias("email")), known)


# ---- checks

@_query("provenance_hashes", "SELECT o_orderkey AS event_id, sha256(concat(o_orderstatus, '||', coalesce(CAST(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey END AS VARCHAR), ''), '||', CASE WHEN o_orderkey % 3 = 0 THEN '{}' ELSE concat('{\"p\":\"', o_orderpriority, '\"}') END)) AS hash FROM orders")
def provenance_hashes(spark, sf_dir):
    k = F.col("o_orderkey")
    payload = F.when(k % 3 != 0, F.concat(F.lit('{"p":"'), "o_orderpriority", F.lit('"}')))
    return table(spark, sf_dir, "orders").select(k.alias("event_id"), checks.provenance_hash(F.col("o_orderstatus"), F.when(k % 5 > 0, k), payload).alias("hash"))


@_query("tampered_rows", "SELECT o_orderkey AS event_id, o_orderkey % 50 <> 0 AS intact FROM orders")
def tampered_rows(spark, sf_dir):
    """Stored hashes against recomputed ones; every fiftieth row was changed after it was stored."""
    k, stored, now = F.col("o_orderkey"), F.col("o_totalprice").cast("string"), F.when(F.col("o_orderkey") % 50 == 0, F.lit("changed")).otherwise(F.col("o_totalprice").cast("string"))
    of = lambda payload: checks.provenance_hash(F.col("o_orderpriority"), k, payload)
    return table(spark, sf_dir, "orders").select(k.alias("event_id"), (of(stored) == of(now)).alias("intact"))


@_query("known_hashes", "SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey % 25 = c.c_custkey % 25 AND sha256(CAST(o.o_orderkey % 900 AS VARCHAR)) = sha256(CAST(c.c_custkey AS VARCHAR))) AS known FROM customer c")
def known_hashes(spark, sf_dir):
    digest = lambda c: F.sha2(c.cast("string"), 256).alias("file_hash")
    held = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("user_id"), digest(F.col("o_orderkey") % 900))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 25).alias("user_id"), digest(F.col("c_custkey")))
    return checks.known_hashes(asked, held).select("id", "known")


@_query("duplicate_candidates", "SELECT file_hash, id FROM (SELECT sha256(CAST(o_orderkey % 900 AS VARCHAR)) AS file_hash, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderkey % 900 ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 10")
def duplicate_candidates(spark, sf_dir):
    """The ten newest records of each hash."""
    from ..operators.search import latest_per_key

    held = table(spark, sf_dir, "orders").withColumn("file_hash", F.sha2((F.col("o_orderkey") % 900).cast("string"), 256))
    return latest_per_key(held, "file_hash", [F.desc("o_orderdate"), F.col("o_orderkey")], 10).select("file_hash", F.col("o_orderkey").alias("id"))


@_query("platform_id_verdicts", """WITH x AS (SELECT o_orderkey AS event_id, CASE o_orderkey % 4 WHEN 0 THEN 'quickbooks' WHEN 1 THEN 'stripe' WHEN 2 THEN 'razorpay' ELSE 'other' END AS p,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'INV-' || o_orderkey WHEN 3 THEN 'ch_' || lpad(CAST(o_orderkey AS VARCHAR), 16, '0') WHEN 4 THEN 'pay_' || lpad(CAST(o_orderkey AS VARCHAR), 14, 'a') WHEN 5 THEN repeat('x', 60) ELSE CAST(o_orderkey AS VARCHAR) END AS v FROM orders)
 SELECT event_id, CASE WHEN v IS NULL OR trim(v) = '' OR length(trim(v)) > 50 THEN false WHEN p = 'quickbooks' THEN regexp_matches(v, '^(TXN-?|INV-?|VEN-?|CUST-?|BILL-?|PAY-?|ACC-?|CLASS-?|ITEM-?|JE-?)?[0-9]{1,8}$') WHEN p = 'stripe' THEN regexp_matches(v, '^(ch_|pi_|cus_|in_)[a-zA-Z0-9]{14,24}$') WHEN p = 'razorpay' THEN regexp_matches(v, '^(pay_|order_|rfnd_|setl_)[a-zA-Z0-9]{14}$') ELSE true END AS is_valid,
  CASE WHEN v IS NULL OR trim(v) = '' THEN 'basic_check' WHEN length(trim(v)) > 50 THEN 'length_check' WHEN p = 'quickbooks' AND NOT regexp_matches(v, '^(TXN-?|INV-?|VEN-?|CUST-?|BILL-?|PAY-?|ACC-?|CLASS-?|ITEM-?|JE-?)?[0-9]{1,8}$') OR p = 'stripe' AND NOT regexp_matches(v, '^(ch_|pi_|cus_|in_)[a-zA-Z0-9]{14,24}$') OR p = 'razorpay' AND NOT regexp_matches(v, '^(pay_|order_|rfnd_|setl_)[a-zA-Z0-9]{14}$') THEN 'platform_specific' ELSE 'format_check' END AS validation_method FROM x""")
def platform_id_verdicts(spark, sf_dir):
    k = F.col("o_orderkey")
    text = k.cast("string")
    platform = F.when(k % 4 == 0, "quickbooks").when(k % 4 == 1, "stripe").when(k % 4 == 2, "razorpay").otherwise("other")
    made = [F.lit("  "), F.concat(F.lit("INV-"), text), F.concat(F.lit("ch_"), F.lpad(text, 16, "0")), F.concat(F.lit("pay_"), F.lpad(text, 14, "a")), F.repeat(F.lit("x"), 60)]
    value = F.when(k % 7 == 6, text)
    for i, v in enumerate(made):
        value = F.when(k % 7 == i + 1, v).otherwise(value)
    verdict = checks.platform_id_verdict(value, platform)
    return table(spark, sf_dir, "orders").select(k.alias("event_id"), verdict.alias("v")).select("event_id", "v.is_valid", "v.validation_method")


@_query("scheduler_limits", """SELECT s.event_type AS provider, strftime(s.minute, '%Y-%m-%d %H:%M') AS minute, s.n AS sent, coalesce(f.n, 0) AS failed, greatest(1, 5 - coalesce(f.n, 0)) AS "limit", s.n < greatest(1, 5 - coalesce(f.n, 0)) AS allowed
 FROM (SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2) s LEFT JOIN (SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS n FROM events WHERE value < 10 GROUP BY 1, 2) f USING (event_type, minute)""")
def scheduler_limits(spark, sf_dir):
    """Events stand for dispatches; those of a value below 10 failed."""
    sent = table(spark, sf_dir, "events").withColumnRenamed("event_type", "provider")
    found = checks.dispatches_within_limit(sent, sent.where("value < 10"))
    return found.select("provider", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "sent", "failed", "limit", "allowed")


@_query("lineage_steps", """SELECT event_id, step_number, step_name, operation FROM (SELECT event_id, 1 AS step_number, 'ingestion' AS step_name, 'read' AS operation FROM events UNION ALL SELECT event_id, 2, event_type, 'classify' FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, 3, 'enrichment', 'join' FROM events WHERE event_id % 3 = 2)""")
def lineage_steps(spark, sf_dir):
    step = lambda name, operation: F.concat(F.lit('{"step":"'), name, F.lit(f'","operation":"{operation}"}}'))
    k = F.col("event_id")
    path = F.concat(F.lit("["), F.concat_ws(",", step(F.lit("ingestion"), "read"), F.when(k % 3 > 0, step(F.col("event_type"), "classify")), F.when(k % 3 == 2, step(F.lit("enrichment"), "join"))), F.lit("]"))
    return checks.lineage_steps(table(spark, sf_dir, "events").select("event_id", path.alias("lineage_path")))


@_query("events_without_old_orphans", f"WITH {ctes('records')} SELECT event_id FROM records r WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = r.file_id AND c.c_acctbal > 0) OR created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR")
def events_without_old_orphans(spark, sf_dir):
    """Files of customers without a positive balance are the ones that are gone."""
    files = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("file_id"))
    return checks.without_orphans(view(spark, sf_dir, "records"), files, _as_of()).select("event_id")


@_query("causal_graph_edges", f"WITH {_HILL} SELECT source_event_id AS src, target_event_id AS dst, causal_score FROM (SELECT source_event_id, target_event_id, {_HILL_SCORES} FROM hill) WHERE causal_score >= 0.7")
def causal_graph_edges(spark, sf_dir):
    ledger = ledger_events(spark, sf_dir)
    links = relationships(ledger)
    scored = relations.bradford_hill(links, ledger).where("causal_score >= 0.7").join(links.select("relationship_id", "source_event_id", "target_event_id"), "relationship_id")
    return scored.select(F.col("source_event_id").alias("src"), F.col("target_event_id").alias("dst"), "causal_score")
