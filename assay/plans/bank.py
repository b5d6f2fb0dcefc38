"""Banking tables: schemas, table facts, weights, the forty known issues as rules, and repair steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assay.functions import columns as fx
from assay.operators import clean, rules as R
from assay.operators.features_banking import is_round

# Column names and types of the source tables.
SCHEMAS = {
    "CUSTOMERS": "customer_id string, first_name string, last_name string, dob string, ssn string, tax_id string, email string, phone string, "
                 "address_line1 string, address_line2 string, city string, state string, zip_code string, country string, kyc_date string, "
                 "kyc_status string, risk_tier string, pep_flag bigint, ofac_screened bigint, created_at string, updated_at string",
    "ACCOUNTS": "account_id string, customer_id string, account_type string, product_code string, balance double, available_balance double, "
                "currency string, interest_rate double, opened_date string, last_activity_date string, status string, dormant_flag bigint, "
                "routing_number string, iban string, branch_id string, credit_limit double, created_at string",
    "TRANSACTIONS": "transaction_id string, account_id string, related_account_id string, transaction_type string, amount double, currency string, "
                    "merchant_name string, merchant_category_code string, channel string, status string, transaction_date string, value_date string, "
                    "reference string, description string, aml_flag bigint, created_at string",
    "CARDS": "card_id string, account_id string, customer_id string, card_number string, card_type string, cardholder_name string, expiry_date string, "
             "cvv_hash string, status string, credit_limit double, available_credit double, issued_date string, last_used_date string, created_at string",
    "LOANS": "loan_id string, customer_id string, account_id string, loan_type string, principal_amount double, outstanding_balance double, "
             "interest_rate double, origination_date string, maturity_date string, next_payment_date string, last_payment_date string, "
             "payment_amount double, payment_frequency string, collateral_type string, collateral_value double, ltv_ratio double, "
             "credit_score bigint, delinquency_days bigint, status string, created_at string",
    "BENEFICIARIES": "beneficiary_id string, customer_id string, full_name string, relationship string, bank_name string, account_number string, "
                     "routing_number string, bic_swift string, bank_country string, verified bigint, verification_date string, "
                     "ofac_screened bigint, risk_tier string, created_at string",
    "RISK_EVENTS": "event_id string, customer_id string, account_id string, transaction_id string, event_type string, risk_score double, severity string, "
                   "alert_source string, opened_date string, resolved_date string, resolution_code string, sar_filed bigint, sar_filing_date string, "
                   "narrative string, status string, created_at string",
    "BRANCHES": "branch_id string, branch_name string, branch_type string, address string, city string, state string, zip_code string, country string, "
                "phone string, manager_id string, swift_bic string, routing_number string, status string, license_number string, "
                "license_expiry string, opened_date string, created_at string",
}
KEYS = {"CUSTOMERS": "customer_id", "ACCOUNTS": "account_id", "TRANSACTIONS": "transaction_id", "CARDS": "card_id", "LOANS": "loan_id",
        "BENEFICIARIES": "beneficiary_id", "RISK_EVENTS": "event_id", "BRANCHES": "branch_id"}
# Domain and regimes per table.
FACTS = [
    ("CUSTOMERS", "KYC / Customer Master", "BSA / AML / KYC / GLBA"), ("ACCOUNTS", "Account Management", "FDIC / Reg E / Reg D / SOX"),
    ("TRANSACTIONS", "Transaction Ledger", "BSA / AML / CTR / FinCEN"), ("CARDS", "Card Services / PCI", "PCI-DSS Level 1 / Reg E"),
    ("LOANS", "Loan Portfolio", "HMDA / CECL / CRA / Basel III"), ("BENEFICIARIES", "Payment Beneficiaries", "FATF / OFAC / Reg E / ISO 20022"),
    ("RISK_EVENTS", "AML / Fraud Risk", "BSA / SAR / FinCEN / ACAMS"), ("BRANCHES", "Branch Network", "OCC / FDIC / CRA / FFIEC"),
]
# Readiness weights per table, in per cent.
WEIGHTS = {
    "CUSTOMERS": {"kyc_completeness": 30, "dedup_integrity": 20, "format_validity": 20, "referential_integrity": 15, "aml_readiness": 15},
    "ACCOUNTS": {"balance_integrity": 25, "product_completeness": 25, "regulatory_flags": 20, "referential_integrity": 20, "freshness": 10},
    "TRANSACTIONS": {"transaction_integrity": 30, "aml_patterns": 25, "merchant_completeness": 20, "temporal_coherence": 15, "dedup": 10},
    "CARDS": {"card_validity": 30, "pci_compliance": 25, "status_accuracy": 20, "referential_integrity": 15, "freshness": 10},
    "LOANS": {"collateral_completeness": 25, "payment_coherence": 25, "regulatory_compliance": 25, "referential_integrity": 15, "freshness": 10},
    "BENEFICIARIES": {"verification_status": 30, "routing_validity": 25, "kyc_linkage": 20, "dedup": 15, "format_validity": 10},
    "RISK_EVENTS": {"resolution_completeness": 30, "sar_timeliness": 25, "pattern_coverage": 20, "regulatory_linkage": 15, "freshness": 10},
    "BRANCHES": {"operational_completeness": 25, "regulatory_compliance": 25, "geo_accuracy": 20, "staff_linkage": 20, "freshness": 10},
}
# Identifiers whose coverage is reported, with the column that carries them here (None: no column).
PCI_COLUMNS = {
    "Primary Account Number (PAN)": "card_number", "Cardholder Name": "cardholder_name", "Card Expiration Date": "expiry_date",
    "CVV / CVC / CID": "cvv_hash", "PIN / PIN Block": None, "Magnetic Stripe Data": None, "Chip Data (ICC)": None,
    "Card Billing Address": None, "Card Verification Value": "cvv_hash", "Token (surrogate PAN)": "card_number_token",
}
KYC_COLUMNS = {
    "Full Legal Name": "last_name", "Date of Birth": "dob", "Government ID (SSN/TIN/Passport)": "ssn", "Physical Address": "address_line1",
    "Email / Phone": "email", "Source of Funds": None, "Beneficial Ownership": None, "PEP Status": "pep_flag",
    "OFAC Screening Result": "ofac_screened", "CDD Risk Rating": "risk_tier", "EDD Documentation": None, "Transaction Monitoring Profile": None,
}

RATE_BEARING = ["SAVINGS", "CD", "MONEY_MARKET", "MORTGAGE", "AUTO_LOAN"]
SECURED = ["MORTGAGE", "AUTO_LOAN", "HOME_EQUITY", "COMMERCIAL"]
MIN_WORDS = 12

REFERENCES = [("ACCOUNTS", "customer_id", "CUSTOMERS", "customer_id"), ("ACCOUNTS", "branch_id", "BRANCHES", "branch_id"),
              ("TRANSACTIONS", "account_id", "ACCOUNTS", "account_id"), ("CARDS", "account_id", "ACCOUNTS", "account_id"),
              ("CARDS", "customer_id", "CUSTOMERS", "customer_id"), ("LOANS", "customer_id", "CUSTOMERS", "customer_id"),
              ("LOANS", "account_id", "ACCOUNTS", "account_id"), ("BENEFICIARIES", "customer_id", "CUSTOMERS", "customer_id"),
              ("RISK_EVENTS", "customer_id", "CUSTOMERS", "customer_id"), ("RISK_EVENTS", "transaction_id", "TRANSACTIONS", "transaction_id")]


def prepare(t: dict[str, DataFrame], filings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Attach what cross-table rules compare with: transactions in another currency, account limits, rate outliers, branch activity, filed addresses."""
    out = dict(t)
    if "ACCOUNTS" in t and "TRANSACTIONS" in t:
        own = t["ACCOUNTS"].select("account_id", F.col("currency").alias("__currency"))
        foreign = t["TRANSACTIONS"].join(own, "account_id").where(F.col("currency") != F.col("__currency")).groupBy("account_id").agg(F.count(F.lit(1)).alias("foreign_txns"))
        out["ACCOUNTS"] = t["ACCOUNTS"].join(foreign, "account_id", "left")
    if "CARDS" in t and "ACCOUNTS" in t:
        limits = t["ACCOUNTS"].select("account_id", F.col("credit_limit").alias("account_limit"))
        out["CARDS"] = t["CARDS"].join(limits, "account_id", "left")
    if "LOANS" in t:
        out["LOANS"] = clean.outliers(t["LOANS"], "interest_rate", ["loan_type"], 3.0, (0.0, 25.0)).withColumnRenamed("outlier", "rate_outlier")
    if "BRANCHES" in t and "ACCOUNTS" in t:
        busy = t["ACCOUNTS"].groupBy("branch_id").agg(F.count(F.lit(1)).alias("open_accounts"))
        out["BRANCHES"] = t["BRANCHES"].join(busy, "branch_id", "left")
    if "BRANCHES" in t and filings is not None:
        out["BRANCHES"] = clean.address_diff(out["BRANCHES"], "branch_id", "address", filings, "filed").withColumnRenamed("mismatch", "address_mismatch")
    return out


def rules(t: dict[str, DataFrame], as_of: str) -> dict[str, list[R.Rule]]:
    """The known issues of each table as rules over prepared tables."""
    day = F.lit(as_of).cast("date")
    date = lambda c: F.col(c).try_cast("date")
    is_true = lambda c: F.col(c) == 1
    parent = lambda n: t[n]
    active_accounts = lambda: parent("ACCOUNTS").where(F.col("status") != "CLOSED")
    out = {
        "CUSTOMERS": [
            R.null_rule("ssn", "missing_ssn"), R.Unique("duplicate_customers", ["first_name", "last_name", "dob"]),
            R.regex_rule("email", "email", "invalid_email"), R.null_rule("kyc_date", "missing_kyc_date"),
            R.all_present("address_incomplete", ["zip_code", "state"]),
            R.all_present("kyc_completeness", ["ssn", "dob", "email", "kyc_date", "state", "zip_code"])],
        "ACCOUNTS": [
            R.Row("negative_balance", (F.col("balance") >= 0) | (F.col("account_type") == "CREDIT")),
            R.implies_rule("missing_rate", F.col("account_type").isin(RATE_BEARING), F.col("interest_rate").isNotNull()),
            R.Row("dormant_unflagged", ~F.coalesce(F.datediff(day, date("last_activity_date")) > 365, F.lit(False)) | is_true("dormant_flag")),
            R.null_rule("product_code", "missing_product_code"),
            R.Row("available_within_balance", F.col("available_balance") <= F.greatest(F.col("balance"), F.lit(0.0)))],
        "TRANSACTIONS": [
            R.Unique("duplicate_txn_id", ["transaction_id"]), R.null_rule("merchant_category_code", "missing_merchant"),
            R.Row("suspicious_round", ~is_round(F.col("amount"))),
            R.Row("future_dated", ~F.coalesce(F.col("transaction_date").try_cast("date") > day, F.lit(False))),
            R.implies_rule("large_flagged", F.col("amount") >= 9000, is_true("aml_flag"))],
        "CARDS": [
            R.Row("expired_active", ~F.coalesce((fx.month_end("expiry_date") < day) & (F.col("status") == "ACTIVE"), F.lit(False))),
            R.luhn_rule("card_number", "invalid_luhn"), R.null_rule("cvv_hash", "missing_cvv_hash")],
        "LOANS": [
            R.implies_rule("missing_collateral", F.col("loan_type").isin(SECURED), F.col("collateral_value").isNotNull()),
            R.Row("past_due_payment", date("next_payment_date") >= day),
            R.implies_rule("missing_ltv", F.col("loan_type") == "MORTGAGE", F.col("ltv_ratio").isNotNull())],
        "BENEFICIARIES": [
            R.bic_rule("bic_swift", "bank_country", id="missing_bic"), R.Row("unverified", is_true("verified")),
            R.implies_rule("stale_routing", F.col("bank_country") == "US", fx.aba_ok("routing_number")),
            R.Unique("duplicate_bene", ["customer_id", "full_name", "routing_number", "account_number"])],
        "RISK_EVENTS": [
            R.Row("unresolved_alerts", ~((F.col("status") == "OPEN") & (F.datediff(day, F.col("opened_date").try_cast("date")) > 30))),
            R.implies_rule("missing_sar", is_true("sar_filed"), F.col("sar_filing_date").isNotNull()),
            R.timeliness_rule("sar_timeliness", "opened_date", "sar_filing_date", is_true("sar_filed"), 30),
            R.Row("incomplete_narrative", clean.word_count("narrative") >= MIN_WORDS), R.null_rule("risk_score", "unscored"),
            R.implies_rule("missing_resolution", F.col("status") == "CLOSED", F.col("resolution_code").isNotNull())],
        "BRANCHES": [
            R.null_rule("manager_id", "missing_manager"), R.bic_rule("swift_bic", "country", id="missing_swift"),
            R.Row("license_expired", F.coalesce(date("license_expiry") >= day, F.lit(False)))],
    }
    if "ACCOUNTS" in t:
        out["TRANSACTIONS"] += [
            R.Exists("orphaned_txn", ["account_id"], parent("ACCOUNTS"), ["account_id"], null_ok=False),
            R.Exists("closed_account", ["account_id"], active_accounts(), ["account_id"])]
        if "foreign_txns" in t["ACCOUNTS"].columns:
            out["ACCOUNTS"] += [R.Row("currency_mismatch", F.col("foreign_txns").isNull())]
        out["CARDS"] += [R.Exists("unlinked_cards", ["account_id"], parent("ACCOUNTS"), ["account_id"], null_ok=False)]
    if "CUSTOMERS" in t:
        out["ACCOUNTS"] += [R.Exists("referential_integrity", ["customer_id"], parent("CUSTOMERS"), ["customer_id"])]
        verified = parent("CUSTOMERS").where(F.col("kyc_status") == "VERIFIED")
        out["BENEFICIARIES"] += [R.Exists("kyc_gap", ["customer_id"], verified, ["customer_id"], null_ok=False)]
    has = lambda table, col: table in t and col in t[table].columns
    if has("CARDS", "account_limit"):
        out["CARDS"] += [R.Row("overlapping_limits", ~F.coalesce(F.col("credit_limit") > F.col("account_limit"), F.lit(False)))]
    if has("LOANS", "rate_outlier"):
        out["LOANS"] += [R.Row("rate_outlier", ~F.col("rate_outlier"))]
    if has("LOANS", "covenant"):
        out["LOANS"] += [R.implies_rule("covenant_missing", F.col("loan_type") == "COMMERCIAL", F.col("covenant").isNotNull())]
    if has("BRANCHES", "open_accounts"):
        out["BRANCHES"] += [R.Row("inactive_processing", ~((F.col("status") == "CLOSED") & (F.coalesce("open_accounts", F.lit(0)) > 0)))]
    if has("BRANCHES", "address_mismatch"):
        out["BRANCHES"] += [R.Row("address_mismatch", ~F.col("address_mismatch"))]
    return out


# Repair steps in our words: table, transition, [(rule that must pass, action)].
REPAIRS = [
    ("CUSTOMERS", "bronze_to_silver", [("invalid_email", "normalise e-mail addresses"), ("address_incomplete", "fill state and postal code from the address table"),
                                       ("duplicate_customers", "merge records that agree on name, birth date and SSN ending")]),
    ("CUSTOMERS", "silver_to_gold", [("kyc_completeness", "complete verification fields"), ("missing_ssn", "fill tax numbers from the vault")]),
    ("CUSTOMERS", "gold_to_platinum", [("missing_kyc_date", "refresh verification on change")]),
    ("ACCOUNTS", "bronze_to_silver", [("negative_balance", "reconcile with the ledger"), ("missing_rate", "fill rates from the product table"),
                                      ("dormant_unflagged", "flag dormant accounts"), ("missing_product_code", "map product codes")]),
    ("ACCOUNTS", "silver_to_gold", [("referential_integrity", "tie every account to a customer"), ("currency_mismatch", "align currencies with the account")]),
    ("TRANSACTIONS", "bronze_to_silver", [("duplicate_txn_id", "drop repeated transactions"), ("missing_merchant", "fill merchant categories"),
                                          ("future_dated", "correct dates from the audit log"), ("orphaned_txn", "set orphans apart")]),
    ("TRANSACTIONS", "silver_to_gold", [("suspicious_round", "test for structuring")]),
    ("CARDS", "bronze_to_silver", [("invalid_luhn", "reject numbers with a wrong check digit"), ("expired_active", "expire cards past their month"),
                                   ("overlapping_limits", "bring limits under the account's"), ("unlinked_cards", "link cards to accounts")]),
    ("CARDS", "silver_to_gold", [("missing_cvv_hash", "replace card data by tokens")]),
    ("LOANS", "bronze_to_silver", [("missing_collateral", "obtain collateral values"), ("missing_ltv", "recompute loan to value"),
                                   ("past_due_payment", "derive delinquency days"), ("rate_outlier", "review rates outside policy")]),
    ("LOANS", "silver_to_gold", [("covenant_missing", "complete covenant fields")]),
    ("BENEFICIARIES", "bronze_to_silver", [("missing_bic", "fill bank codes from the directory"), ("unverified", "verify accounts"),
                                           ("stale_routing", "check routing numbers"), ("duplicate_bene", "merge entries per customer"),
                                           ("kyc_gap", "link to verified customers")]),
    ("RISK_EVENTS", "bronze_to_silver", [("unresolved_alerts", "flag overdue alerts"), ("missing_sar", "fill filing dates"),
                                         ("incomplete_narrative", "complete short narratives"), ("unscored", "score by rules"),
                                         ("missing_resolution", "fill outcome codes")]),
    ("BRANCHES", "bronze_to_silver", [("inactive_processing", "suspend closed branches"), ("missing_manager", "assign managers"),
                                      ("address_mismatch", "reconcile addresses"), ("missing_swift", "fill bank codes"),
                                      ("license_expired", "renew licences")]),
]


def repair_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPAIRS, "table_name string, transition string, steps array<struct<rule_id string, action string>>")


def weight_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, f, w) for t, ws in WEIGHTS.items() for f, w in ws.items()], "table_name string, factor string, weight int")


def fact_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FACTS, "table_name string, domain string, regimes string")
