"""Catalogues of platforms and document types: their words, field names and weights.

The built-in ones are small; `read_catalog` takes a larger one from a YAML or
JSON file of the layout {category: {id: {name, indicators, keywords, field_patterns, confidence_boost}}},
or the same without the categories.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Label:
    """One platform or document type."""

    id: str
    name: str
    category: str
    words: tuple[str, ...]
    field_patterns: tuple[str, ...]
    boost: float = 1.0


def _labels(table: list[tuple[str, str, str, float, str, str]]) -> list[Label]:
    listed = lambda text: tuple(w.strip() for w in text.split(","))
    return [Label(key, name, category, listed(words), listed(fields), boost) for key, name, category, boost, words, fields in table]


# Platforms with their category, weight, indicators and field patterns.
PLATFORMS = _labels([
    ("stripe", "Stripe", "payment_gateway", 0.9, "stripe, stripe.com, stripe_, ch_, pi_, cus_, acct_, payment_intent, charge_id, customer_id, account_id, stripe payment, stripe charge, stripe customer", "stripe_id, charge_id, payment_intent_id"),
    ("razorpay", "Razorpay", "payment_gateway", 0.9, "razorpay, razorpay.com, rzp_, pay_, order_, refund_, razorpay payment, razorpay payout, razorpay subscription", "razorpay_id, payment_id, order_id, refund_id"),
    ("paypal", "PayPal", "payment_gateway", 0.9, "paypal, paypal.com, pp_, paypal payment, paypal transaction, payer_id, transaction_id, payment_id", "paypal_id, transaction_id, payer_id"),
    ("square", "Square", "payment_gateway", 0.9, "square, squareup.com, sq_, square payment, square transaction, square invoice, square payroll", "square_id, transaction_id, invoice_id"),
    ("chase", "Chase Bank", "banking", 0.8, "chase, chase bank, jpmorgan chase, chase.com, chase account, chase statement, chase transaction", "chase_account, account_number"),
    ("wells_fargo", "Wells Fargo", "banking", 0.8, "wells fargo, wellsfargo.com, wells fargo bank, wells fargo account, wells fargo statement", "wells_fargo_account, account_number"),
    ("bank_of_america", "Bank of America", "banking", 0.8, "bank of america, bofa, bankofamerica.com, bofa account, bofa statement, bofa transaction", "bofa_account, account_number"),
    ("quickbooks", "QuickBooks", "accounting", 0.9, "quickbooks, qb, quickbooks.com, intuit quickbooks, qb invoice, qb payment, qb expense, qb payroll", "qb_id, invoice_id, customer_id, vendor_id"),
    ("xero", "Xero", "accounting", 0.9, "xero, xero.com, xero invoice, xero payment, xero expense, xero payroll, xero accounting", "xero_id, contact_id, invoice_id"),
    ("freshbooks", "FreshBooks", "accounting", 0.9, "freshbooks, freshbooks.com, freshbooks invoice, freshbooks payment, freshbooks expense", "freshbooks_id, invoice_id, client_id"),
    ("wave", "Wave", "accounting", 0.9, "wave, waveapps.com, wave invoice, wave payment, wave expense, wave accounting", "wave_id, invoice_id, customer_id"),
    ("salesforce", "Salesforce", "crm", 0.9, "salesforce, salesforce.com, sf_, salesforce crm, lead_id, opportunity_id, account_id, contact_id", "sf_id, lead_id, opportunity_id, account_id"),
    ("hubspot", "HubSpot", "crm", 0.9, "hubspot, hubspot.com, hs_, hubspot crm, contact_id, deal_id, company_id", "hubspot_id, contact_id, deal_id"),
    ("pipedrive", "Pipedrive", "crm", 0.9, "pipedrive, pipedrive.com, pd_, pipedrive crm, deal_id, person_id, organization_id", "pipedrive_id, deal_id, person_id"),
    ("shopify", "Shopify", "ecommerce", 0.9, "shopify, shopify.com, shopify store, shopify order, shopify payment, shopify customer, shopify product", "shopify_id, order_id, customer_id, product_id"),
    ("woocommerce", "WooCommerce", "ecommerce", 0.9, "woocommerce, woocommerce order, woocommerce payment, woocommerce customer, woocommerce product", "wc_id, order_id, customer_id"),
    ("amazon", "Amazon", "ecommerce", 0.8, "amazon, amazon.com, amazon order, amazon payment, amazon seller, amazon fba, amazon marketplace", "amazon_id, order_id, seller_id"),
    ("aws", "Amazon Web Services", "cloud_services", 0.9, "aws, amazon web services, aws billing, aws invoice, aws cost, aws usage, ec2, s3, lambda", "aws_id, instance_id, bucket_name"),
    ("azure", "Microsoft Azure", "cloud_services", 0.9, "azure, microsoft azure, azure billing, azure invoice, azure cost, azure usage, azure vm, azure storage", "azure_id, vm_id, storage_account"),
    ("google_cloud", "Google Cloud Platform", "cloud_services", 0.9, "google cloud, gcp, google cloud platform, gcp billing, gcp invoice, gcp cost, gcp usage, compute engine", "gcp_id, project_id, instance_id"),
    ("gusto", "Gusto", "payroll", 0.9, "gusto, gusto.com, gusto payroll, gusto employee, gusto salary, gusto benefits, gusto tax", "gusto_id, employee_id, payroll_id"),
    ("bamboohr", "BambooHR", "payroll", 0.9, "bamboohr, bamboohr.com, bamboo hr, bamboo payroll, bamboo employee, bamboo salary", "bamboo_id, employee_id, hr_id"),
    ("adp", "ADP", "payroll", 0.9, "adp, adp.com, adp payroll, adp employee, adp salary, adp benefits, adp tax", "adp_id, employee_id, payroll_id"),
    ("robinhood", "Robinhood", "investment", 0.9, "robinhood, robinhood.com, robinhood trading, robinhood investment, robinhood portfolio", "robinhood_id, trade_id, position_id"),
    ("etrade", "E*TRADE", "investment", 0.9, "etrade, etrade.com, e*trade, etrade trading, etrade investment, etrade portfolio", "etrade_id, trade_id, account_id"),
])

# Document types with their category, weight, keywords and field patterns. Longer indicator lists come from a file.
DOCUMENT_TYPES = _labels([
    ("invoice", "Invoice", "financial", 0.9, "invoice, bill, charge, amount due, payment terms", "invoice_number, bill_number, invoice_date, due_date, total_amount"),
    ("receipt", "Receipt", "financial", 0.9, "receipt, purchase, paid, transaction, change", "receipt_number, transaction_id, purchase_date, total_paid"),
    ("bank_statement", "Bank Statement", "financial", 0.9, "bank, statement, account, balance, deposit, withdrawal", "account_number, statement_period, opening_balance, closing_balance"),
    ("credit_card_statement", "Credit Card Statement", "financial", 0.9, "credit card, card, credit limit, minimum payment", "card_number, credit_limit, available_credit, minimum_payment"),
    ("payroll", "Payroll", "financial", 0.9, "payroll, salary, employee, pay period, deduction", "employee_id, pay_period, gross_pay, net_pay, deductions"),
    ("tax_document", "Tax Document", "financial", 0.9, "tax, return, 1040, w-2, 1099, refund", "tax_year, filing_status, adjusted_gross_income, tax_owed"),
    ("contract", "Contract", "business", 0.8, "contract, agreement, terms, party, effective date", "contract_number, effective_date, termination_date, party_name"),
    ("purchase_order", "Purchase Order", "business", 0.9, "purchase order, po number, vendor, supplier", "po_number, po_date, vendor_name, delivery_date"),
    ("quotation", "Quotation", "business", 0.9, "quotation, quote, quote number, valid until", "quote_number, quote_date, valid_until, customer_name"),
    ("proposal", "Proposal", "business", 0.8, "proposal, proposal number, scope of work, deliverables", "proposal_number, proposal_date, client_name, project_name"),
    ("legal_document", "Legal Document", "legal", 0.8, "legal, attorney, court, case number, plaintiff", "case_number, filing_date, plaintiff, defendant"),
    ("insurance_document", "Insurance Document", "legal", 0.9, "insurance, policy, coverage, premium, claim", "policy_number, coverage_period, premium_amount, deductible"),
    ("medical_bill", "Medical Bill", "healthcare", 0.9, "medical, hospital, patient, diagnosis, treatment", "patient_id, diagnosis_code, procedure_code, insurance_id"),
    ("prescription", "Prescription", "healthcare", 0.9, "prescription, medication, dosage, pharmacy, refill", "prescription_number, medication_name, dosage, quantity"),
    ("government_document", "Government Document", "government", 0.8, "government, permit, license, registration, official", "permit_number, license_number, registration_number, department"),
    ("utility_bill", "Utility Bill", "government", 0.9, "utility, electric, gas, water, bill", "account_number, service_address, billing_period, usage_amount"),
    ("personal_document", "Personal Document", "personal", 0.7, "personal, individual, private, confidential", "id_number, date_of_birth, address, phone_number"),
    ("educational_document", "Educational Document", "education", 0.8, "education, school, student, grade, transcript", "student_id, course_code, grade, gpa"),
])


def read_catalog(path: str) -> list[Label]:
    """Labels in the order of the file; keywords come before indicators. A file of the driver, read once."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        held = json.loads(text)
    else:
        import yaml

        held = yaml.safe_load(text)
    flat: dict[str, dict] = {}
    for key, value in held.items():
        own = "indicators" in value or "keywords" in value
        flat |= {key: value} if own else {k: v | {"category": v.get("category", key)} for k, v in value.items()}
    return [
        Label(key, v.get("name", key), v.get("category", "unknown"), tuple(map(str, [*v.get("keywords", []), *v.get("indicators", [])])), tuple(map(str, v.get("field_patterns", []))), float(v.get("confidence_boost", 1.0)))
        for key, v in flat.items()
    ]
