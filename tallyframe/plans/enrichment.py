"""Queries for classification, normalisation, resolution statistics and graph views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, rules, similarity
from ..operators import communities, search
from ..sources.adapters import LEDGER_SQL, RELATIONSHIPS_SQL, entity_edges, ledger_events, relationships, table
from ..sources.records import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LEDGER, RELATED = f"WITH {LEDGER_SQL}", f"WITH {RELATIONSHIPS_SQL}"


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@_query("business_logic_aliases", """SELECT o_orderkey AS id, ['payroll_processing', 'payroll_processing', 'loan_repayment', 'refund_processing', 'tax_withholding', 'standard_payment_flow', 'standard_payment_flow', 'unknown', 'unknown',
 'standard_payment_flow', 'standard_payment_flow', 'recurring_billing', 'unknown', 'asset_depreciation'][o_orderkey % 14 + 1] AS logic FROM orders""")
def business_logic_aliases(spark, sf_dir):
    return view(spark, sf_dir, "spoken").select("id", rules.business_logic(F.col("logic")).alias("logic"))


@_query("entity_kinds", "SELECT o_orderkey AS id, ['vendor', 'vendor', 'customer', 'contact', 'project', 'contact', 'contact', 'employee', 'contact'][o_orderkey % 9 + 1] AS kind FROM orders")
def entity_kinds(spark, sf_dir):
    return view(spark, sf_dir, "spoken").select("id", rules.entity_kind(F.col("kind")).alias("kind"))


@_query("payload_validation", """SELECT o_orderkey, abs(o_totalprice*1000) <= 100000000 AS amount_ok, CASE WHEN o_orderstatus='F' THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN o_orderkey % 3 = 2 THEN 0.5 ELSE CAST(o_orderkey % 3 AS DOUBLE) END AS confidence FROM orders""")
def payload_validation(spark, sf_dir):
    currency = F.when(F.col("o_orderstatus") == "F", "EUR").otherwise("XXX")
    checked = rules.checked_payload(F.col("o_totalprice") * 1000, currency, (F.col("o_orderkey") % 3).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", checked.alias("x")).select("o_orderkey", "x.*")


@_query("extracted_ids", f"""{LEDGER} SELECT event_id, 'customer:' || lpad(CAST(file_id AS VARCHAR), 9, '0') || ',invoice:' || event_id AS ids FROM ledger_events""")
def extracted_ids(spark, sf_dir):
    text = F.concat_ws(" ", "vendor_standard", F.concat(F.lit("inv-"), F.col("event_id").cast("string")))
    return ledger_events(spark, sf_dir).select("event_id", F.array_join(rules.found_ids(text), ",").alias("ids"))


@_query("document_class_tfidf")
def document_class_tfidf(spark, sf_dir):
    profiles = {"english": ["the", "and", "of"], "german": ["der", "die", "und"], "french": ["le", "les", "et"], "spanish": ["el", "los", "y"]}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = rules.tfidf_class(docs, "doc_id", F.split(F.lower("text"), r"\s+"), profiles)
    return found.withColumn("score", F.round("score", 6))


@_query("custom_rules", f"{LEDGER} SELECT CASE WHEN amount_usd > 400000 THEN 'large' WHEN document_type='transfer' THEN 'internal' ELSE 'plain' END AS outcome, count(*) AS n FROM ledger_events GROUP BY 1")
def custom_rules(spark, sf_dir):
    outcome = rules.first_rule([("amount_usd > 400000", "large"), ("document_type = 'transfer'", "internal")], "plain")
    return ledger_events(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@_query("relationship_scores", f"""{RELATED} SELECT relationship_id, round(least(1.0, 0.3*least(a.x,b.x)/greatest(a.x,b.x) + 0.2 + 0.2*(CASE WHEN a.p=b.p THEN 1 ELSE 0 END) + 0.2*r.confidence_score + 0.1*0.5),6) AS score
 FROM relationships r JOIN (SELECT event_id, CAST(amount_usd AS DOUBLE) AS x, source_platform AS p FROM ledger_events) a ON r.source_event_id=a.event_id JOIN (SELECT event_id, CAST(amount_usd AS DOUBLE) AS x, source_platform AS p FROM ledger_events) b ON r.target_event_id=b.event_id""")
def relationship_scores(spark, sf_dir):
    ledger = ledger_events(spark, sf_dir)
    a, b = (ledger.select(F.col("event_id").alias(f"{s}_event_id"), F.col("amount_usd").alias(f"{s}_amount"), F.col("source_platform").alias(f"{s}_platform")) for s in ("source", "target"))
    joined = relationships(ledger).join(a, "source_event_id").join(b, "target_event_id")
    same = (F.col("source_platform") == F.col("target_platform")).cast("int")
    score = rules.relationship_score(cleaning.compare_amounts(F.col("source_amount"), F.col("target_amount")), F.lit(1.0), same, F.col("confidence_score"), F.lit(0.5))
    return joined.select("relationship_id", F.round(score, 6).alias("score"))


@_query("resolution_statistics", """SELECT event_type AS method, count(*) AS n, round(avg(value),6) AS avg_value, count(*) FILTER (value > 50) AS hits, round(count(*) FILTER (value > 50)/nullif(count(*),0),6) AS hit_rate FROM events GROUP BY 1""")
def resolution_statistics(spark, sf_dir):
    hits = F.count_if(F.col("value") > 50)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"), hits.alias("hits"), F.round(hits / F.count("*"), 6).alias("hit_rate"))


@_query("resolution_patterns_union", """SELECT 'type' AS dimension, event_type AS item, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2""")
def resolution_patterns_union(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    count = lambda name, c: events.groupBy(F.lit(name).alias("dimension"), c.cast("string").alias("item")).agg(F.count("*").alias("n"))
    return count("type", F.col("event_type")).unionByName(count("user", F.col("user_id")))


@_query("relationship_statistics", f"{RELATED} SELECT count(*) AS total, string_agg(relationship_type || '=' || n, ',' ORDER BY relationship_type) AS by_type FROM (SELECT relationship_type, count(*) AS n FROM relationships GROUP BY 1)".replace("SELECT count(*) AS total", "SELECT CAST(sum(n) AS BIGINT) AS total"))
def relationship_statistics(spark, sf_dir):
    counts = relationships(ledger_events(spark, sf_dir)).groupBy("relationship_type").agg(F.count("*").alias("n"))
    pair = F.concat("relationship_type", F.lit("="), F.col("n").cast("string"))
    return counts.agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("by_type"))


@_query("vectors_above_threshold", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id=(SELECT min(vec_id) FROM embeddings)), s AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], e::DOUBLE[])/(sqrt(list_dot_product(embedding::DOUBLE[],embedding::DOUBLE[]))*sqrt(list_dot_product(e::DOUBLE[],e::DOUBLE[]))),6) AS similarity FROM embeddings, q) SELECT * FROM s WHERE similarity >= 0.3""")
def vectors_above_threshold(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    joined = vectors.join(F.broadcast(query))
    return joined.select("vec_id", F.round(similarity.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity")).where("similarity >= 0.3")


@_query("best_field_mapping", """SELECT user_id, event_type AS source, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, value DESC, event_id) AS n FROM events) WHERE n = 1""")
def best_field_mapping(spark, sf_dir):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    found = search.latest_per_key(table(spark, sf_dir, "events"), "user_id", [rank, F.desc("value"), F.asc("event_id")], 1)
    return found.select("user_id", F.col("event_type").alias("source"), "value")


@_query("json_key_search", "SELECT event_id FROM events WHERE json_extract_string(props,'$.k') = '69'")
def json_key_search(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k") == "69").select("event_id")


@_query("connected_platforms_missing", f"{LEDGER} SELECT DISTINCT source_platform FROM ledger_events WHERE source_platform NOT IN ('MACHINERY','BUILDING')")
def connected_platforms_missing(spark, sf_dir):
    known = spark.createDataFrame([("MACHINERY",), ("BUILDING",)], "source_platform string")
    return ledger_events(spark, sf_dir).select("source_platform").distinct().join(F.broadcast(known), "source_platform", "left_anti")


@_query("graph_communities")
def graph_communities(spark, sf_dir):
    return communities.label_propagation(entity_edges(spark, sf_dir))


@_query("event_provenance", f"{LEDGER} SELECT event_id, 'file=' || file_id || ';platform=' || source_platform AS provenance FROM ledger_events")
def event_provenance(spark, sf_dir):
    return ledger_events(spark, sf_dir).select("event_id", F.concat(F.lit("file="), F.col("file_id").cast("string"), F.lit(";platform="), "source_platform").alias("provenance"))
