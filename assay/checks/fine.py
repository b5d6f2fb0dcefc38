"""Values with more than two digits after the point, and nulls: rates, laboratory values, ratios."""

from pyspark.sql import DataFrame, functions as F

from assay.checks.registry import Tables, query
from assay.operators import clean, features as H, features_clinical as C, monitor as I, rules as R
from assay.plans import bank

# Five digits after the point, and a null in every seventh row.
PARTS = "SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice / 1000 END AS rate FROM part"
EVENTS = "SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value / 1000 END AS rate FROM events"
D = "CAST({} AS DECIMAL(38,12))".format


def parts(t: Tables) -> DataFrame:
    return t.sql(PARTS, part=t.part)


def rates(t: Tables) -> DataFrame:
    return t.sql(EVENTS, events=t.events)


@query("e1_impute_fine", f"""
WITH p AS ({PARTS}), g AS (SELECT p_brand, CAST(sum({D('rate')}) AS DOUBLE) / count(rate) AS m FROM p GROUP BY 1)
SELECT p_partkey, rate IS NULL AS rate_imputed, round(coalesce(rate, m), 8) AS rate FROM p JOIN g USING (p_brand)
""")
def impute_fine(t: Tables) -> DataFrame:
    return clean.impute(parts(t), {"rate": ("group_mean", "p_brand")}).select("p_partkey", "rate_imputed", F.round("rate", 8).alias("rate"))


@query("e21_outliers_fine", f"""
WITH p AS ({PARTS}), g AS (SELECT p_brand, avg(rate) AS m, stddev_pop(rate) AS s FROM p GROUP BY 1)
SELECT p_brand, count(*) AS rows, count(*) FILTER (abs(rate - m) > 1.3::DOUBLE * s) AS outliers, round(max(m), 7) AS mean, round(max(s), 7) AS sd FROM p JOIN g USING (p_brand) GROUP BY 1
""")
def outliers_fine(t: Tables) -> DataFrame:
    return clean.outliers(parts(t), "rate", ["p_brand"], 1.3).groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("outlier").alias("outliers"), F.round(F.max("group_mean"), 7).alias("mean"), F.round(F.max("group_sd"), 7).alias("sd"))


@query("h1_rolling_fine", f"""
WITH d AS (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS tick, count(*) AS n, count(rate) AS c, sum({D('rate')}) AS a FROM ({EVENTS}) GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER w AS nw, sum(c) OVER w AS cw, sum(a) OVER w AS aw FROM d WINDOW w AS (PARTITION BY user_id ORDER BY tick RANGE BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT user_id, strftime(DATE '1970-01-01' + CAST(tick AS INTEGER), '%Y-%m-%d') AS day, CAST(nw AS BIGINT) AS n_7d, coalesce(round(CAST(aw AS DOUBLE), 7), -1) AS sum_7d,
  coalesce(round(CAST(aw AS DOUBLE) / nullif(cw, 0), 10), -1) AS avg_7d FROM w
""")
def rolling_fine(t: Tables) -> DataFrame:
    out = H.rolling_features(rates(t), "user_id", "ts", "rate", (7,))
    return out.select("user_id", F.col("day").cast("string").alias("day"), "n_7d", F.coalesce(F.round(F.col("sum_7d").cast("double"), 7), F.lit(-1.0)).alias("sum_7d"),
                      F.coalesce(F.round("avg_7d", 10), F.lit(-1.0)).alias("avg_7d"))


@query("h6_zscore_fine", f"""
WITH p AS ({PARTS}) SELECT p_partkey, coalesce(round((rate - m) / s, 5), -99) AS z FROM p, (SELECT avg(rate) AS m, stddev_pop(rate) AS s FROM p)
""")
def zscore_fine(t: Tables) -> DataFrame:
    return H.normalise(parts(t), ["rate"]).select("p_partkey", F.coalesce(F.round("rate_norm", 5), F.lit(-99.0)).alias("z"))


@query("h18_trend_fine", f"""
WITH e AS (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS x, CAST(rate AS DECIMAL(28,6)) AS y FROM ({EVENTS}) WHERE rate IS NOT NULL),
d AS (SELECT user_id, x, count(*) AS n, sum(y) AS y FROM e GROUP BY 1, 2),
w AS (SELECT user_id, x, sum(n) OVER w AS n, sum(n * x) OVER w AS sx, sum(y) OVER w AS sy, sum(n * x * x) OVER w AS sxx, sum(y * x) OVER w AS sxy
      FROM d WINDOW w AS (PARTITION BY user_id ORDER BY x RANGE BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT user_id, strftime(DATE '1970-01-01' + CAST(x AS INTEGER), '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n,
  coalesce(round(CAST(n * sxy - sx * sy AS DOUBLE) / nullif(CAST(n * sxx - sx * sx AS DOUBLE), 0), 12), -99) AS slope FROM w
""")
def trend_fine(t: Tables) -> DataFrame:
    return C.trend(rates(t), ["user_id"], "ts", "rate").select(
        "user_id", F.col("day").cast("string").alias("day"), "n", F.coalesce(F.round("slope", 12), F.lit(-99.0)).alias("slope"))


@query("f9_codes_in_a_table", """
WITH codes AS (SELECT DISTINCT p_brand FROM part WHERE p_size <= 25), k AS (SELECT p_brand IN (SELECT p_brand FROM codes) AS known, regexp_matches(p_brand, '^Brand#[1-3][0-9]$') AS shaped FROM part)
SELECT 'code_known' AS rule_id, count(*) AS rows, count(*) FILTER (NOT known) AS failed FROM k UNION ALL SELECT 'code_validity', count(*), count(*) FILTER (NOT shaped) FROM k
""")
def codes(t: Tables) -> DataFrame:
    known = t.part.where("p_size <= 25").select("p_brand").distinct()
    return R.run_rules(t.part, "part", [R.Exists("code_known", ["p_brand"], known, ["p_brand"], null_ok=False), R.code_rule("p_brand", "^Brand#[1-3][0-9]$", None, "code_validity")]).select(
        "rule_id", "rows", "failed")


@query("f16_velocity_fine", f"""
WITH k AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS tick, count(*) AS n, sum({D('rate')}) AS a FROM ({EVENTS}) GROUP BY 1, 2),
w AS (SELECT user_id, tick, sum(n) OVER w AS nw, sum(a) OVER w AS aw FROM k WINDOW w AS (PARTITION BY user_id ORDER BY tick RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW))
SELECT user_id, tick, CAST(nw AS BIGINT) AS n_24h, coalesce(round(CAST(aw AS DOUBLE), 7), -1) AS amount_24h FROM w
""")
def velocity_fine(t: Tables) -> DataFrame:
    df = rates(t)
    out = R.velocity_rule(df, "user_id", "ts", F.col("rate").cast("decimal(38,12)"), {"24h": (86400, 6, 500.0)})
    return out.select("user_id", "tick", "n_24h", F.coalesce(F.round(F.col("amount_24h").cast("double"), 7), F.lit(-1.0)).alias("amount_24h"))


ALLOWED = [("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("signup", "view"), ("error", "view")]
GAPS = "SELECT event_id, ts, user_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS state FROM events"


@query("i16_transitions_with_gaps", f"""
SELECT event_id, p AS previous, state FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ({GAPS}) WHERE state IS NOT NULL)
WHERE p IS NOT NULL AND p <> state AND (p, state) NOT IN ({', '.join(str(a) for a in ALLOWED)})
""")
def transitions_gaps(t: Tables) -> DataFrame:
    return I.illegal_transitions(t.sql(GAPS, events=t.events), "user_id", ["ts", "event_id"], "state", ALLOWED).select("event_id", "previous", "state")


# The banking pack over the given tables, projected into its schemas.
ACCOUNTS = """
SELECT CAST(c_custkey AS STRING) AS account_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'CREDIT' WHEN 'MACHINERY' THEN 'SAVINGS' ELSE 'CHECKING' END AS account_type,
  CASE WHEN c_nationkey IS NOT NULL THEN c_mktsegment END AS product_code, c_acctbal AS balance, c_acctbal - 1 AS available_balance, CASE WHEN c_custkey % 9 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE WHEN c_custkey % 2 = 0 THEN 1.5 END AS interest_rate, CASE WHEN c_custkey % 5 = 0 THEN '2000-01-01' ELSE '2001-06-01' END AS last_activity_date,
  CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS dormant_flag, CASE WHEN c_custkey % 13 = 0 THEN 'CLOSED' ELSE 'ACTIVE' END AS status FROM customer"""
TRANSACTIONS = """
SELECT CAST(o_orderkey AS STRING) AS transaction_id, CAST(o_custkey AS STRING) AS account_id, o_totalprice AS amount, 'USD' AS currency,
  CASE WHEN o_orderstatus <> 'P' THEN '5411' END AS merchant_category_code, CAST(o_orderdate AS DATE) AS transaction_date,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS aml_flag FROM orders"""


def pack_sql(table: str, source: str, tests: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{rule}' AS rule_id, count(*) AS rows, count(*) FILTER ({bad}) AS failed FROM {source}" for rule, bad in tests.items())


@query("f2bis_banking_pack", f"""
WITH a AS ({ACCOUNTS.replace('STRING', 'VARCHAR')}), x AS ({TRANSACTIONS.replace('STRING', 'VARCHAR').replace('FROM orders', 'FROM {orders_dirty}')}),
foreign_accounts AS (SELECT DISTINCT account_id FROM x JOIN a USING (account_id) WHERE x.currency <> a.currency)
""" + pack_sql("ACCOUNTS", "a", {
    "negative_balance": "NOT coalesce(balance >= 0 OR account_type = 'CREDIT', false)", "missing_rate": "account_type = 'SAVINGS' AND interest_rate IS NULL",
    "dormant_unflagged": "date_diff('day', last_activity_date::DATE, DATE '2001-08-02') > 365 AND dormant_flag <> 1", "missing_product_code": "product_code IS NULL",
    "available_within_balance": "available_balance > greatest(balance, 0)", "currency_mismatch": "account_id IN (SELECT account_id FROM foreign_accounts)"}) + " UNION ALL " + pack_sql("TRANSACTIONS", "x", {
    "duplicate_txn_id": "false", "missing_merchant": "merchant_category_code IS NULL", "suspicious_round": "NOT coalesce(NOT (amount > 0 AND amount % 1000 = 0), false)",
    "future_dated": "transaction_date > DATE '2001-08-02'", "large_flagged": "amount >= 9000 AND aml_flag <> 1",
    "orphaned_txn": "account_id NOT IN (SELECT account_id FROM a)", "closed_account": "account_id NOT IN (SELECT account_id FROM a WHERE status <> 'CLOSED')"}))
def banking_pack(t: Tables) -> DataFrame:
    tables = bank.prepare({"ACCOUNTS": t.sql(ACCOUNTS, customer=t.customer), "TRANSACTIONS": t.sql(TRANSACTIONS, orders=t.orders_dirty)})
    rules = bank.rules(tables, "2001-08-02")
    out = R.run_rules(tables["ACCOUNTS"], "ACCOUNTS", rules["ACCOUNTS"]).unionByName(R.run_rules(tables["TRANSACTIONS"], "TRANSACTIONS", rules["TRANSACTIONS"]))
    return out.select("table_name", "rule_id", "rows", "failed")
