"""Wider records of the ledger, as views of the driver's tables: one text each for Spark and DuckDB.

A name in braces is a table or an earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .adapters import ledger_events, relationships, table

VIEWS = {
    # events with money, review and platform columns
    "records": """SELECT o.o_orderkey AS event_id, CAST(c.c_nationkey AS BIGINT) AS user_id, o.o_custkey AS file_id, CAST(o.o_orderkey % 1000 AS INT) AS row_index,
      CASE o.o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'payment' ELSE 'transfer' END AS document_type, CAST(o.o_orderkey % 100 AS DOUBLE) / 100 AS document_confidence,
      CASE o.o_orderstatus WHEN 'F' THEN 'revenue' WHEN 'O' THEN 'expense' ELSE 'transfer' END AS category,
      CASE o.o_orderstatus WHEN 'F' THEN 'income' WHEN 'O' THEN 'expense' ELSE 'transfer' END AS transaction_type,
      lower(c.c_mktsegment) AS source_platform, CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE c.c_name END AS vendor_standard,
      CASE WHEN o.o_orderkey % 3 = 0 THEN concat(c.c_name, ' Inc.') ELSE c.c_name END AS vendor_raw, 0.7 + CAST(o.o_orderkey % 25 AS DOUBLE) / 100 AS vendor_confidence,
      CASE c.c_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'INR' END AS currency,
      CASE c.c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(1.09 AS DOUBLE) WHEN 2 THEN CAST(1.27 AS DOUBLE) ELSE CAST(0.012 AS DOUBLE) END AS exchange_rate,
      CAST(o.o_totalprice AS DECIMAL(15,2)) AS amount_original,
      CAST(CAST(o.o_totalprice AS DECIMAL(15,2)) * CASE c.c_nationkey % 4 WHEN 0 THEN CAST(1 AS DECIMAL(5,3)) WHEN 1 THEN CAST(1.09 AS DECIMAL(5,3)) WHEN 2 THEN CAST(1.27 AS DECIMAL(5,3)) ELSE CAST(0.012 AS DECIMAL(5,3)) END AS DECIMAL(15,2)) AS amount_usd,
      o.o_orderdate AS source_ts, o.o_orderdate AS created_at, o.o_orderkey % 4 <> 0 AS accuracy_enhanced, o.o_orderkey % 17 <> 0 AS is_valid,
      o.o_orderkey % 10 < 3 AS requires_review, CASE substring(o.o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE NULL END AS review_priority,
      CASE WHEN o.o_orderkey % 5 = 0 THEN concat('ch_', CAST(o.o_orderkey AS STRING)) END AS platform_id,
      concat('clerk ', CAST(o.o_orderkey % 40 AS STRING)) AS employee, CASE WHEN o.o_orderkey % 6 = 0 THEN concat('project ', CAST(o.o_orderkey % 9 AS STRING)) END AS project,
      CASE o.o_orderkey % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END AS status
     FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "linked": """SELECT r.*, CASE WHEN relationship_id % 3 = 0 THEN NULL ELSE concat('link ', relationship_type) END AS semantic_description,
      CASE relationship_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'revenue_recognition' WHEN 2 THEN 'expense_reimbursement' ELSE 'standard_payment_flow' END AS business_logic,
      concat('next in file for ', relationship_type) AS reasoning, CASE WHEN relationship_id % 2 = 0 THEN 'rule' ELSE 'semantic' END AS detection_method FROM {relationships} r""",
    "transactions": """SELECT o_orderkey AS id, o_custkey % 25 AS user_id, CASE o_orderkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'committed' WHEN 2 THEN 'rolled_back' ELSE 'failed' END AS status,
      o_orderdate AS started_at, CAST(o_orderkey % 600 AS INT) AS seconds FROM {orders}""",
    "mappings": """SELECT p_partkey AS id, p_partkey % 25 AS user_id, p_type AS source_column, p_brand AS target_field, CASE p_size % 3 WHEN 0 THEN NULL ELSE concat('platform', CAST(p_size % 3 AS STRING)) END AS platform,
      CAST(p_partkey % 100 AS DOUBLE) / 100 AS confidence, p_size AS usage_count, CAST(floor(p_size / 2) AS INT) AS success_count FROM {part}""",
    "platform_patterns": """SELECT CAST(s_nationkey AS BIGINT) AS user_id, concat('platform', CAST(s_suppkey % 10 AS STRING)) AS platform,
      concat('{"pattern_type":"', CASE WHEN s_suppkey % 2 = 0 THEN 'field' ELSE 'value' END, '","confidence_score":', CAST(CAST(s_suppkey % 100 AS DECIMAL(5,2)) / 100 AS DECIMAL(3,2)), ',"detection_method":"rule","pattern_data":{"n":', CAST(s_suppkey AS STRING), '}}') AS patterns,
      CAST('2024-01-01' AS DATE) + CAST(s_suppkey AS INT) AS updated_at FROM {supplier}""",
    "discovered": """SELECT CAST(s_nationkey AS BIGINT) AS user_id, concat('found', CAST(s_suppkey % 7 AS STRING)) AS platform_name, 'header match' AS discovery_reason, CAST(s_suppkey % 100 AS DOUBLE) / 100 AS confidence_score,
      CAST('2024-02-01' AS DATE) + CAST(s_suppkey AS INT) AS discovered_at FROM {supplier} WHERE s_suppkey % 3 = 0""",
    "normalized": """SELECT event_id AS id, user_id, props AS normalized_payload, event_type AS document_type, CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'stripe' ELSE 'quickbooks' END AS platform_label,
      CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS confidence, value > 50 AS requires_review, CASE WHEN event_id % 7 = 0 THEN event_id % 100 END AS duplicate_group_id, ts AS normalized_at FROM {events}""",
    "matches": """SELECT o_orderkey AS id, o_custkey % 25 AS user_id, o_custkey AS entity_id, CASE o_orderkey % 5 WHEN 0 THEN 'exact_name' WHEN 1 THEN 'fuzzy_name' WHEN 2 THEN 'email' WHEN 3 THEN 'bank_account' ELSE 'new_entity' END AS match_method,
      CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence FROM {orders}""",
    "entity_table": """SELECT c_custkey AS entity_id, c_custkey % 25 AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'employee' WHEN 1 THEN 'vendor' WHEN 2 THEN 'customer' ELSE 'project' END AS entity_type,
      c_name AS canonical_name, lower(replace(c_name, '#', ' ')) AS alias, CAST('2024-01-01' AS DATE) + CAST(c_custkey % 300 AS INT) AS last_seen FROM {customer}""",
    "memos": """SELECT o_orderkey AS event_id, CASE o_orderkey % 8 WHEN 0 THEN 'Monthly SALARY run' WHEN 1 THEN 'Payment received, thanks' WHEN 2 THEN 'electricity bill' WHEN 3 THEN 'wages' WHEN 4 THEN 'nan' WHEN 5 THEN 'card fee 2' WHEN 6 THEN 'costs of sales' END AS memo, o_orderpriority AS priority FROM {orders}""",
    "told": """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'Source to target' WHEN 1 THEN ' bidirectional ' WHEN 2 THEN 'two way street' WHEN 3 THEN 'Correlation' WHEN 4 THEN NULL WHEN 5 THEN '' WHEN 6 THEN 'by chance' WHEN 7 THEN 'reverse_causality' ELSE 'correlation_only' END AS told FROM {orders}""",
    "pattern_bodies": """SELECT s_suppkey AS id, CASE s_suppkey % 8 WHEN 0 THEN '{"pattern_type":"a","confidence_score":0.5,"detection_method":"m","pattern_data":{"n":1}}' WHEN 1 THEN '{"pattern_type":"a","confidence_score":1,"detection_method":"m"}' WHEN 2 THEN '{"pattern_type":"a","confidence_score":"0.5","detection_method":"m","pattern_data":{}}'
 WHEN 3 THEN '{"pattern_type":"a","confidence_score":1.5,"detection_method":"m","pattern_data":{}}' WHEN 4 THEN '{"pattern_type":"a","confidence_score":0,"detection_method":"m","pattern_data":[]}' WHEN 5 THEN '{"pattern_type":null,"confidence_score":0.1,"detection_method":"m","pattern_data":{}}' WHEN 6 THEN '{"pattern_type":"a","confidence_score":1,"detection_method":"m","pattern_data":{"k":[1]}}' END AS body FROM {supplier}""",
    "cells": """SELECT o_custkey AS file_id, CASE o_orderkey % 13 WHEN 0 THEN 'see #REF!' WHEN 1 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END * CAST(o_orderkey % 3 AS INT) AS amount FROM {orders}""",
    "headers": """SELECT CAST(s_nationkey AS BIGINT) AS file_id, CASE s_suppkey % 7 WHEN 0 THEN ' Net_Revenue' WHEN 1 THEN 'total_assets' WHEN 2 THEN 'operating_cash_flow' WHEN 3 THEN 'Gross_Profit' WHEN 4 THEN 'cash' WHEN 5 THEN 'nan' ELSE s_name END AS name FROM {supplier}""",
    "named_files": """SELECT p_partkey AS file_id, CAST(p_size AS BIGINT) AS user_id, p_name AS file_hash, 'processed' AS status FROM {part}""",
    "payloads": """SELECT o_orderkey AS id, o_custkey % 25 AS user_id, CASE o_orderkey % 12 WHEN 0 THEN concat('Stripe payment ch_', CAST(o_orderkey AS STRING), ' for customer_id ', CAST(o_custkey AS STRING))
      WHEN 1 THEN concat('QB invoice INV-', CAST(o_orderkey AS STRING), ' via QuickBooks.com') WHEN 2 THEN concat('razorpay payout pay_', CAST(o_orderkey AS STRING), ' order_9') WHEN 3 THEN 'Amazon order, amazon.com marketplace'
      WHEN 4 THEN 'AWS billing: ec2 and s3 usage' WHEN 5 THEN 'wire, no words' WHEN 6 THEN 'Xero invoice, then a Wave invoice' WHEN 7 THEN 'gusto payroll and adp payroll, contact_id' WHEN 8 THEN NULL WHEN 9 THEN ''
      WHEN 10 THEN 'Shopify store order paid by PayPal payment, payment_id and transaction_id' ELSE concat('Hospital bill for patient, insurance claim and tax refund 1040 of employee ', CAST(o_orderkey AS STRING)) END AS memo,
      CASE o_custkey % 4 WHEN 0 THEN 'id,Charge_ID,amount' WHEN 1 THEN 'invoice_id,customer_id,total' WHEN 2 THEN 'order_id,payment_id' ELSE NULL END AS field_names FROM {orders}""",
    "dated_amounts": """SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 10 < 9 THEN 'EUR' WHEN o_orderkey % 30 = 9 THEN 'GBP' WHEN o_orderkey % 30 = 19 THEN 'INR' ELSE 'XXX' END AS currency,
      CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(15,2)) AS amount FROM {orders}""",
    "dated_rates": """SELECT CASE o_custkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'INR' END AS currency, CAST(o_orderdate AS DATE) AS day, CAST(0.5 + CAST(max(o_orderkey) % 1000 AS DOUBLE) / 1000 AS DOUBLE) AS rate
      FROM {orders} WHERE o_orderkey % 4 = 0 GROUP BY 1, 2""",
    # the tables around relationships, from which the enriched view is joined
    "instances": """SELECT relationship_id AS id, user_id, source_event_id, target_event_id, relationship_type, confidence_score, relationship_id % 7 AS pattern_id FROM {relationships}""",
    "causal_rows": """SELECT relationship_id, user_id, CAST(relationship_id % 100 AS DOUBLE) / 100 AS causal_score, temporal_causality AS causal_direction FROM {relationships} WHERE relationship_id % 3 = 0""",
    "temporal_rows": """SELECT min(relationship_id) AS id, user_id, relationship_type, CAST(count(*) % 10 AS DOUBLE) / 10 AS confidence_score, CAST(CAST(count(*) % 300 AS DOUBLE) / 10 AS DECIMAL(10,1)) AS avg_days_between,
      CAST(count(*) % 30 AS INT) AS seasonal_period_days, CAST(count(*) % 8 AS DOUBLE) AS seasonal_amplitude FROM {relationships} WHERE user_id % 4 <> 0 GROUP BY user_id, relationship_type""",
    "pattern_rows": """SELECT DISTINCT relationship_id % 7 AS id, user_id, concat('pattern of ', CAST(relationship_id % 7 AS STRING)) AS relationship_type FROM {relationships} WHERE relationship_id % 7 < 5""",
    "cross_rows": """SELECT relationship_id + 1000000 AS id, user_id, source_event_id, target_event_id, concat('platform ', CAST(relationship_id % 5 AS STRING)) AS source_platform FROM {relationships} WHERE relationship_id % 4 = 0""",
    "predicted_rows": """SELECT relationship_id + 2000000 AS id, user_id, source_event_id, CASE relationship_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'fulfilled' ELSE 'expired' END AS status, CAST(0.25 AS DOUBLE) AS confidence_score, 'due' AS prediction_reasoning FROM {relationships} WHERE relationship_id % 5 < 2
      UNION ALL SELECT relationship_id + 3000000, user_id, source_event_id, 'pending', CAST(0.75 AS DOUBLE), 'late' FROM {relationships} WHERE relationship_id % 10 = 0""",
    "cause_rows": """SELECT relationship_id + 4000000 AS id, user_id, source_event_id AS problem_event_id, concat('cause of ', CAST(relationship_id AS STRING)) AS root_cause_description FROM {relationships} WHERE relationship_id % 9 = 0""",
    # rows of three kinds of files as JSON objects
    "raw_rows": """SELECT o_orderkey AS id, o_custkey % 50 AS file_id, CASE o_orderkey % 3
      WHEN 0 THEN concat('{"Invoice Date":"', CAST(CAST(o_orderdate AS DATE) AS STRING), '","Total Amount":"$', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING), '","Vendor Name":" Customer ', CAST(o_custkey AS STRING), ' Inc.","Currency":"eur","Notes":"', o_orderpriority, '"}')
      WHEN 1 THEN concat('{"price":"', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING), '","supplier":"Customer ', CAST(o_custkey AS STRING), '","ccy":"GBP","when":"', CAST(CAST(o_orderdate AS DATE) AS STRING), 'T10:00:00","memo":"","contact":"a', CAST(o_custkey AS STRING), '@mail.com","site":null}')
      ELSE concat('{"status":"', o_orderstatus, '","value":"-', CAST(o_custkey AS STRING), '","key":"K', CAST(o_orderkey AS STRING), '"}') END AS row_text FROM {orders}""",
    # rows that hold identifiers of platforms, in columns, in words or not at all
    "id_rows": """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Stripe' WHEN 1 THEN 'quickbooks' WHEN 2 THEN 'xero' WHEN 3 THEN 'gusto' WHEN 4 THEN 'razorpay' ELSE 'paypal' END AS platform,
      CASE o_orderkey % 6 WHEN 0 THEN concat('{"reference":"ch_abc', CAST(o_orderkey AS STRING), '","memo":"x"}') WHEN 1 THEN concat('{"Invoice No":" inv-00', CAST(o_orderkey + 1000 AS STRING), '","note":"Vendor #', CAST(o_orderkey + 500 AS STRING), '"}')
      WHEN 2 THEN '{"id":"INV-2024-000123"}' WHEN 3 THEN concat('{"text":"paid emp_77a', CAST(o_orderkey AS STRING), ' to ts_9zz","amount":"5"}') ELSE '{"memo":"none here"}' END AS row_text FROM {orders}""",
    "spoken": """SELECT o_orderkey AS id, CASE o_orderkey % 14 WHEN 0 THEN 'Payroll' WHEN 1 THEN 'payroll run' WHEN 2 THEN ' Loan Repayment ' WHEN 3 THEN 'refunds issued' WHEN 4 THEN 'Tax payments' WHEN 5 THEN NULL WHEN 6 THEN '' WHEN 7 THEN 'unknown' WHEN 8 THEN 'gift'
      WHEN 9 THEN 'vendor payments' WHEN 10 THEN 'INVOICE_PAYMENT for x' WHEN 11 THEN 'pattern based forecast' WHEN 12 THEN '  ' ELSE 'Asset_Management' END AS logic,
      CASE o_orderkey % 9 WHEN 0 THEN 'Vendors' WHEN 1 THEN 'supplier' WHEN 2 THEN 'CLIENTS' WHEN 3 THEN 'people' WHEN 4 THEN 'project' WHEN 5 THEN 'staff' WHEN 6 THEN NULL WHEN 7 THEN 'Employee' ELSE ' vendor' END AS kind FROM {orders}""",
    # entities that are known before the events are read: vendors of two kinds of names, and clerks
    "known_entities": """SELECT c_custkey AS entity_id, CAST(c_nationkey AS BIGINT) AS user_id, 'vendor' AS entity_type, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE concat('The ', c_name) END AS canonical_name,
      CASE WHEN c_custkey % 3 = 1 THEN concat(c_name, ',', c_name, ' Inc.') ELSE 'nobody' END AS alias_list, CAST('1990-01-01' AS DATE) AS last_seen FROM {customer} WHERE c_custkey % 2 = 0
      UNION ALL SELECT 10000000 + n_nationkey, CAST(n_nationkey AS BIGINT), 'employee', concat('clerk ', CAST(n_nationkey AS STRING)), 'Clerk 1,clerk 2', CAST('2030-01-01' AS DATE) FROM {nation} WHERE n_nationkey % 3 = 0""",
    "decisions": """SELECT p_partkey AS file_id, CAST(p_size AS BIGINT) AS user_id, p_name AS file_hash, CASE p_partkey % 5 WHEN 0 THEN 'replace' WHEN 1 THEN 'keep_both' WHEN 2 THEN 'skip' ELSE 'delta_merge' END AS decision FROM {part}""",
}


def view(spark: SparkSession, sf_dir: str, name: str, **held: DataFrame) -> DataFrame:
    """The view; `held` gives tables that are made already, as relationships=..., which several views then share."""
    needs = set(re.findall(r"\{([a-z_]+)\}", VIEWS[name]))
    found = {n: held[n] if n in held else relationships(ledger_events(spark, sf_dir)) if n == "relationships" else table(spark, sf_dir, n) for n in needs}
    return spark.sql(_escaped(VIEWS[name], needs), **found)


def _escaped(text: str, needs: set[str]) -> str:
    """Braces that are no table names are doubled, as spark.sql() formats the text."""
    out, at = [], 0
    for m in re.finditer("|".join(rf"\{{{n}\}}" for n in sorted(needs)), text):
        out += [text[at : m.start()].replace("{", "{{").replace("}", "}}"), m[0]]
        at = m.end()
    return "".join([*out, text[at:].replace("{", "{{").replace("}", "}}")])


def ctes(*names: str) -> str:
    """The views as common table expressions for DuckDB; `relationships` must come from the adapters' text."""
    return ", ".join(f"{n} AS ({re.sub(r'{([a-z_]+)}', r'\1', VIEWS[n]).replace('AS STRING', 'AS VARCHAR')})" for n in names)
