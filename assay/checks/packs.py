"""The banking rule set over the given tables, projected into its schemas: six more tables, one query each."""

from pyspark.sql import DataFrame

from assay.checks.fine import pack_sql
from assay.checks.registry import Tables, query
from assay.operators import rules as R
from assay.plans import bank

DAY = "2001-08-02"
CUSTOMERS = """
SELECT CAST(c_custkey AS STRING) AS customer_id, CONCAT('f', CAST(c_custkey % 400 AS STRING)) AS first_name, c_mktsegment AS last_name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CONCAT('19', CAST(50 + c_nationkey AS STRING), '-01-01') END AS dob, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE '123-45-6789' END AS ssn,
  CASE WHEN c_custkey % 7 = 0 THEN 'no mail' WHEN c_custkey % 7 = 1 THEN NULL ELSE 'a@b.org' END AS email, CASE WHEN c_acctbal < 0 THEN NULL ELSE '2000-01-01' END AS kyc_date,
  CASE WHEN c_custkey % 5 = 0 THEN 'PENDING' ELSE 'VERIFIED' END AS kyc_status, CASE WHEN c_custkey % 13 = 0 THEN ' ' ELSE 'NY' END AS state,
  CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE '10001' END AS zip_code FROM customer"""
ACCOUNTS = """
SELECT CAST(c_custkey AS STRING) AS account_id, CAST(c_custkey % 60 AS STRING) AS branch_id, c_acctbal - c_custkey % 3 AS credit_limit,
  CASE WHEN c_custkey % 13 = 0 THEN 'CLOSED' ELSE 'ACTIVE' END AS status FROM customer"""
CARDS = """
SELECT CAST(o_orderkey AS STRING) AS card_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'gone' ELSE CAST(o_custkey AS STRING) END AS account_id,
  CASE WHEN o_orderkey % 8 = 0 THEN '4111111111111112' ELSE '4111111111111111' END AS card_number, CASE WHEN o_orderkey % 6 = 0 THEN '07/2001' ELSE '08/2001' END AS expiry_date,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'h' END AS cvv_hash, CASE WHEN o_orderkey % 4 = 0 THEN 'BLOCKED' ELSE 'ACTIVE' END AS status, o_totalprice / 40 AS credit_limit FROM orders"""
LOANS = """
SELECT CAST(o_orderkey AS STRING) AS loan_id, CASE WHEN o_orderkey % 3 = 0 THEN 'MORTGAGE' WHEN o_orderkey % 3 = 1 THEN 'COMMERCIAL' ELSE 'PERSONAL' END AS loan_type,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS collateral_value, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 80.0 END AS ltv_ratio,
  CASE WHEN o_orderkey % 12 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN '2001-08-01' ELSE '2001-08-02' END AS next_payment_date,
  CASE WHEN o_orderkey % 50 = 0 THEN 30.0D ELSE 4.0D + o_orderkey % 3 END AS interest_rate FROM orders"""
BENEFICIARIES = """
SELECT CAST(c_custkey AS STRING) AS beneficiary_id, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE CAST(c_custkey - c_custkey % 2 AS STRING) END AS customer_id, c_mktsegment AS full_name, '1' AS account_number,
  CASE WHEN c_custkey % 6 = 0 THEN '0210000' WHEN c_custkey % 6 = 1 THEN NULL ELSE '021000021' END AS routing_number,
  CASE WHEN c_custkey % 8 < 2 THEN NULL WHEN c_custkey % 8 = 2 THEN 'bad' ELSE 'CITIUS33' END AS bic_swift, CASE WHEN c_custkey % 16 < 5 THEN 'DE' WHEN c_custkey % 16 = 5 THEN NULL ELSE 'US' END AS bank_country,
  CASE WHEN c_custkey % 9 = 0 THEN 0 WHEN c_custkey % 9 = 1 THEN NULL ELSE 1 END AS verified FROM customer"""
RISK_EVENTS = """
SELECT CAST(event_id AS STRING) AS event_id, CASE WHEN event_type = 'error' THEN 'OPEN' ELSE 'CLOSED' END AS status, CAST(CAST(ts AS DATE) AS STRING) AS opened_date,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS sar_filed, CASE WHEN event_id % 12 = 0 THEN NULL WHEN event_id % 12 = 3 THEN '2024-02-10' ELSE '2024-01-31' END AS sar_filing_date,
  CASE WHEN event_id % 4 = 0 THEN 'only three words' WHEN event_id % 4 = 1 THEN NULL ELSE 'one two three four five six seven eight nine ten eleven twelve' END AS narrative,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS risk_score, CASE WHEN event_id % 14 = 0 THEN NULL ELSE 'DONE' END AS resolution_code FROM events"""
BRANCHES = """
SELECT CAST(s_suppkey AS STRING) AS branch_id, CASE WHEN s_suppkey % 4 = 0 THEN 'CLOSED' ELSE 'ACTIVE' END AS status, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'm' END AS manager_id,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'CITIUS33' END AS swift_bic, CASE WHEN s_nationkey < 12 THEN 'US' ELSE 'GB' END AS country,
  CASE WHEN s_suppkey % 9 = 0 THEN '2001-08-01' WHEN s_suppkey % 9 = 1 THEN NULL ELSE '2001-08-02' END AS license_expiry,
  CASE WHEN s_suppkey % 6 = 0 THEN '99 Elm' ELSE '12 North Main Street' END AS address FROM supplier"""
FILED = "SELECT CAST(s_suppkey AS STRING) AS branch_id, '12 N. Main St' AS filed FROM supplier WHERE s_suppkey % 11 <> 0"


def duck(sql: str) -> str:
    return sql.replace("AS STRING)", "AS VARCHAR)").replace(".0D", ".0::DOUBLE")


def results(tables: dict[str, DataFrame], name: str, day: str = DAY, filings: DataFrame | None = None) -> DataFrame:
    made = bank.prepare(tables, filings)
    return R.run_rules(made[name], name, bank.rules(made, day)[name]).select("table_name", "rule_id", "rows", "failed")


BLANK = "({c} IS NULL OR trim({c}) = '')"


@query("f2bis_pack_customers", f"WITH c AS (SELECT *, count(*) OVER (PARTITION BY first_name, last_name, dob) AS n FROM ({duck(CUSTOMERS)}) x)" + pack_sql("CUSTOMERS", "c", {
    "missing_ssn": "ssn IS NULL", "duplicate_customers": "n > 1", "invalid_email": "email = 'no mail'", "missing_kyc_date": "kyc_date IS NULL",
    "address_incomplete": " OR ".join(BLANK.format(c=c) for c in ("zip_code", "state")),
    "kyc_completeness": " OR ".join(BLANK.format(c=c) for c in ("ssn", "dob", "email", "kyc_date", "state", "zip_code"))}))
def pack_customers(t: Tables) -> DataFrame:
    return results({"CUSTOMERS": t.sql(CUSTOMERS, customer=t.customer)}, "CUSTOMERS")


@query("f2bis_pack_cards", f"WITH a AS ({duck(ACCOUNTS)}), k AS (SELECT k.*, a.credit_limit AS account_limit FROM ({duck(CARDS)}) k LEFT JOIN a USING (account_id))" + pack_sql("CARDS", "k", {
    "expired_active": "expiry_date = '07/2001' AND status = 'ACTIVE'", "invalid_luhn": "card_number = '4111111111111112'", "missing_cvv_hash": "cvv_hash IS NULL",
    "unlinked_cards": "account_id IS NULL OR account_id NOT IN (SELECT account_id FROM a)", "overlapping_limits": "credit_limit > account_limit"}))
def pack_cards(t: Tables) -> DataFrame:
    return results({"CARDS": t.sql(CARDS, orders=t.orders), "ACCOUNTS": t.sql(ACCOUNTS, customer=t.customer)}, "CARDS")


@query("f2bis_pack_loans", f"WITH l AS ({duck(LOANS)})" + pack_sql("LOANS", "l", {
    "missing_collateral": "loan_type IN ('MORTGAGE', 'COMMERCIAL') AND collateral_value IS NULL", "past_due_payment": "NOT coalesce(next_payment_date >= '2001-08-02', false)",
    "missing_ltv": "loan_type = 'MORTGAGE' AND ltv_ratio IS NULL", "rate_outlier": "interest_rate = 30"}))
def pack_loans(t: Tables) -> DataFrame:
    return results({"LOANS": t.sql(LOANS, orders=t.orders)}, "LOANS")


@query("f2bis_pack_beneficiaries", f"WITH c AS ({duck(CUSTOMERS)}), b AS (SELECT *, count(*) OVER (PARTITION BY customer_id, full_name, routing_number, account_number) AS n FROM ({duck(BENEFICIARIES)}) x)" + pack_sql("BENEFICIARIES", "b", {
    "missing_bic": "(bic_swift IS NULL AND bank_country = 'DE') OR bic_swift = 'bad'", "unverified": "NOT coalesce(verified = 1, false)",
    "stale_routing": "bank_country = 'US' AND NOT coalesce(routing_number = '021000021', false)", "duplicate_bene": "n > 1",
    "kyc_gap": "customer_id IS NULL OR customer_id NOT IN (SELECT customer_id FROM c WHERE kyc_status = 'VERIFIED')"}))
def pack_beneficiaries(t: Tables) -> DataFrame:
    return results({"BENEFICIARIES": t.sql(BENEFICIARIES, customer=t.customer), "CUSTOMERS": t.sql(CUSTOMERS, customer=t.customer)}, "BENEFICIARIES")


@query("f2bis_pack_risk_events", f"WITH e AS ({duck(RISK_EVENTS)})" + pack_sql("RISK_EVENTS", "e", {
    "unresolved_alerts": "status = 'OPEN' AND date_diff('day', opened_date::DATE, DATE '2024-02-15') > 30", "missing_sar": "sar_filed = 1 AND sar_filing_date IS NULL",
    "sar_timeliness": "sar_filed = 1 AND NOT coalesce(date_diff('day', opened_date::DATE, sar_filing_date::DATE) <= 30, false)", "incomplete_narrative": "NOT coalesce(narrative LIKE 'one%', false)",
    "unscored": "risk_score IS NULL", "missing_resolution": "status = 'CLOSED' AND resolution_code IS NULL"}))
def pack_risk_events(t: Tables) -> DataFrame:
    return results({"RISK_EVENTS": t.sql(RISK_EVENTS, events=t.events)}, "RISK_EVENTS", "2024-02-15")


@query("f2bis_pack_branches", f"WITH a AS ({duck(ACCOUNTS)}), b AS (SELECT b.*, filed FROM ({duck(BRANCHES)}) b LEFT JOIN ({duck(FILED)}) f USING (branch_id))" + pack_sql("BRANCHES", "b", {
    "missing_manager": "manager_id IS NULL", "missing_swift": "swift_bic IS NULL AND country = 'GB'", "license_expired": "NOT coalesce(license_expiry >= '2001-08-02', false)",
    "inactive_processing": "status = 'CLOSED' AND branch_id IN (SELECT branch_id FROM a)", "address_mismatch": "address = '99 Elm' OR filed IS NULL"}))
def pack_branches(t: Tables) -> DataFrame:
    tables = {"BRANCHES": t.sql(BRANCHES, supplier=t.supplier), "ACCOUNTS": t.sql(ACCOUNTS, customer=t.customer)}
    return results(tables, "BRANCHES", filings=t.sql(FILED, supplier=t.supplier))
