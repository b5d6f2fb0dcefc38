"""Sales and finance tables: schemas, table facts and rules as plain data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assay.operators import rules as R

# Column names and types of the source tables.
SCHEMAS = {
    "CUSTOMERS": "customer_id string, first_name string, last_name string, email string, phone string, ssn string, dob string, "
                 "address string, city string, state string, zip string, country string, credit_limit double, status string, "
                 "created_date string, updated_date string",
    "ORDERS": "order_id string, customer_id string, product_id string, order_date string, ship_date string, amount double, "
              "quantity bigint, status string, region string, created_date string",
    "PRODUCTS": "product_id string, name string, category string, price double, description string, stock_qty bigint, sku string, created_date string",
    "EMPLOYEES": "emp_id string, first_name string, last_name string, email string, ssn string, department string, salary double, "
                 "hire_date string, manager_id string, status string",
    "FINANCIALS": "txn_id string, account_id string, amount double, txn_date string, txn_type string, currency string, description string, created_date string",
    "INVENTORY": "item_id string, product_id string, warehouse string, qty_on_hand bigint, reorder_level bigint, last_updated string, unit_cost double",
    "CONTRACTS": "contract_id string, customer_id string, start_date string, end_date string, value double, status string, terms_text string, created_date string",
    "RISK_EVENTS": "event_id string, customer_id string, event_type string, severity string, event_date string, description string, resolved bigint, created_date string",
}
KEYS = {"CUSTOMERS": "customer_id", "ORDERS": "order_id", "PRODUCTS": "product_id", "EMPLOYEES": "emp_id", "FINANCIALS": "txn_id",
        "INVENTORY": "item_id", "CONTRACTS": "contract_id", "RISK_EVENTS": "event_id"}
# Domain and personal-data columns per table.
FACTS = [
    ("CUSTOMERS", "CRM", ["email", "ssn", "dob", "phone"]), ("ORDERS", "Sales", []), ("PRODUCTS", "Catalog", []),
    ("EMPLOYEES", "HR", ["email", "ssn"]), ("FINANCIALS", "Finance", []), ("INVENTORY", "Supply Chain", []),
    ("CONTRACTS", "Legal", []), ("RISK_EVENTS", "Risk", []),
]
# Accepted codes.
CURRENCIES = ["USD", "EUR", "GBP", "CAD", "AUD", "JPY", "CHF"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
CONTRACT_STATUSES = ["ACTIVE", "EXPIRED", "PENDING", "TERMINATED"]

REFERENCES = [("ORDERS", "customer_id", "CUSTOMERS", "customer_id"), ("INVENTORY", "product_id", "PRODUCTS", "product_id"),
              ("CONTRACTS", "customer_id", "CUSTOMERS", "customer_id"), ("RISK_EVENTS", "customer_id", "CUSTOMERS", "customer_id"),
              ("EMPLOYEES", "manager_id", "EMPLOYEES", "emp_id")]


def rules(t: dict[str, DataFrame], as_of: str, max_age_days: int = 730) -> dict[str, list[R.Rule]]:
    """The general rule types on each table; references only where the parent is given."""
    fk = lambda child: [R.Exists(f"referential:{c}", [c], t[p].where(F.col(k).isNotNull()), [k])
                        for x, c, p, k in REFERENCES if x == child and p in t]
    stale = lambda c: R.Row(f"freshness:{c}", F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.col(c).try_cast("date")) <= max_age_days, F.lit(False)))
    return {
        "CUSTOMERS": [R.null_rule("email"), R.Unique("uniqueness:customer_id", ["customer_id"]), R.range_rule("credit_limit", lo=0),
                      R.regex_rule("email", "email"), R.regex_rule("phone", "phone"), R.regex_rule("ssn", "ssn"), stale("updated_date")],
        "ORDERS": [R.null_rule("amount"), R.Unique("uniqueness:order_id", ["order_id"]), R.range_rule("amount", lo=0),
                   R.date_rule("dates", [("order_date", "ship_date")]), *fk("ORDERS")],
        "PRODUCTS": [R.null_rule("price"), R.Unique("uniqueness:product_id", ["product_id"]), R.range_rule("price", lo=0), R.range_rule("stock_qty", lo=0)],
        "EMPLOYEES": [R.null_rule("email"), R.Unique("uniqueness:emp_id", ["emp_id"]), R.range_rule("salary", lo=0),
                      R.regex_rule("ssn", "ssn"), R.regex_rule("email", "email"), *fk("EMPLOYEES")],
        "FINANCIALS": [R.null_rule("amount"), R.Unique("uniqueness:txn_id", ["txn_id"]), R.in_rule("currency", CURRENCIES)],
        "INVENTORY": [R.null_rule("qty_on_hand"), R.Unique("uniqueness:item_id", ["item_id"]), R.range_rule("qty_on_hand", lo=0),
                      *fk("INVENTORY"), stale("last_updated")],
        "CONTRACTS": [R.null_rule("value"), R.Unique("uniqueness:contract_id", ["contract_id"]), R.in_rule("status", CONTRACT_STATUSES),
                      R.date_rule("dates", [("start_date", "end_date")]), *fk("CONTRACTS")],
        "RISK_EVENTS": [R.null_rule("severity"), R.Unique("uniqueness:event_id", ["event_id"]), R.in_rule("severity", SEVERITIES), *fk("RISK_EVENTS")],
    }
