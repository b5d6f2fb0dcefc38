"""Domain rules and scores carried over to the test tables."""

from pyspark.sql import DataFrame, functions as F

from assay.checks.registry import Tables, query
from assay.checks.rules import LINEITEM_RULES, ORDERS_RULES, dated, results
from assay.checks.scores import outcome_sql
from assay.functions import columns as fx, patterns
from assay.operators import features_banking as B, features_clinical as C, govern as G, graph, profile, rules as R, score
from assay.session import cut

D = "CAST({} AS DECIMAL(18,2))".format
RESULTS = outcome_sql(ORDERS_RULES + " UNION ALL " + LINEITEM_RULES)


@query("b2_schema_profile_sizes", """
SELECT 'orders' AS table_name, 6 AS columns, count(*) AS rows, count(*) * 6 AS cells FROM orders
UNION ALL SELECT 'customer', 5, count(*), count(*) * 5 FROM customer
""")
def schema_sizes(t: Tables) -> DataFrame:
    shape = profile.schema_profile(t.spark, {"orders": t.orders, "customer": t.customer}).groupBy("table_name").agg(F.count(F.lit(1)).cast("int").alias("columns"))
    counts = profile.table_counts({"orders": t.orders, "customer": t.customer})
    return shape.join(counts, "table_name").withColumn("cells", F.col("rows") * F.col("columns"))


@query("b6_coverage", """
SELECT 'Name' AS identifier, 'c_name' AS column_name, true AS present, CAST(count(c_name) AS DOUBLE) / count(*) AS populated FROM {customer_dirty}
UNION ALL SELECT 'Nation', 'c_nationkey', true, CAST(count(c_nationkey) AS DOUBLE) / count(*) FROM {customer_dirty}
UNION ALL SELECT 'Tax number', 'none', false, 0.0
""")
def coverage(t: Tables) -> DataFrame:
    out = profile.coverage_summary(t.customer_dirty, {"Name": "c_name", "Nation": "c_nationkey", "Tax number": None})
    return out.withColumn("column_name", F.coalesce("column_name", F.lit("none")))


@query("b10_sensitive_column_lists", f"""
SELECT 'documents' AS table_name, 1 AS n_columns, 'text' AS columns FROM documents HAVING count(*) FILTER (regexp_matches(text, '{patterns.EMAIL}')) > 0
UNION ALL SELECT 'pages', 1, 'html' FROM pages HAVING count(*) FILTER (regexp_matches(html, '{patterns.EMAIL}')) > 0
""")
def column_lists(t: Tables) -> DataFrame:
    email = {"email": patterns.SENSITIVE["email"]}
    flags = profile.detect_sensitive(t.documents, "documents", email).unionByName(profile.detect_sensitive(t.pages, "pages", email))
    return profile.sensitive_columns(flags).withColumn("columns", F.array_join("columns", ","))


@query("c2_health_factors", f"""
WITH r AS ({RESULTS}), f AS (SELECT table_name,
  coalesce(avg(pass_rate) FILTER (rule_id LIKE 'null_check%'), 100) AS phi_completeness, coalesce(avg(pass_rate) FILTER (rule_id LIKE 'accepted%'), 100) AS clinical_code_validity,
  coalesce(avg(pass_rate) FILTER (rule_id LIKE 'range%'), 100) AS temporal_coherence, coalesce(avg(pass_rate) FILTER (rule_id LIKE 'fk%'), 100) AS referential_integrity,
  coalesce(avg(pass_rate) FILTER (rule_id LIKE 'unique%'), 100) AS deid_readiness FROM r GROUP BY 1)
SELECT *, CAST(floor((25 * phi_completeness::DECIMAL(9,4) + 25 * clinical_code_validity::DECIMAL(9,4) + 20 * temporal_coherence::DECIMAL(9,4)
  + 15 * referential_integrity::DECIMAL(9,4) + 15 * deid_readiness::DECIMAL(9,4)) / 100) AS INTEGER) AS score FROM f
""")
def health_factors(t: Tables) -> DataFrame:
    groups = {"phi_completeness": ["null_check:o_totalprice", "null_check:l_quantity"], "clinical_code_validity": ["accepted:o_orderstatus"],
              "temporal_coherence": ["range:o_totalprice", "range:l_quantity"], "referential_integrity": ["fk:o_custkey", "fk:l_orderkey"],
              "deid_readiness": ["unique:o_orderkey", "unique:line"]}
    return score.readiness(score.measure_health_factors(results(t), groups), score.HEALTH_WEIGHTS)


WEIGHTS = [("orders", "null_check:o_totalprice", 40), ("orders", "fk:o_custkey", 35), ("orders", "accepted:o_orderstatus", 25), ("lineitem", "unique:line", 100)]
WEIGHT_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {w})" for a, b, w in WEIGHTS) + ")"


@query("c3_weighted_readiness", f"""
SELECT r.table_name, CAST(floor(sum(pass_rate::DECIMAL(9,4) * w) / 100) AS INTEGER) AS score FROM ({RESULTS}) r
JOIN {WEIGHT_SQL} v(table_name, rule_id, w) ON v.table_name = r.table_name AND v.rule_id = r.rule_id GROUP BY 1
""")
def weighted(t: Tables) -> DataFrame:
    weights = t.spark.createDataFrame(WEIGHTS, "table_name string, factor string, weight int")
    return score.readiness_by_table(results(t).select("table_name", F.col("rule_id").alias("factor"), F.col("pass_rate").alias("value")), weights)


@query("c5_c8_c10_compliance", f"""
WITH s AS (SELECT r.table_name, CAST(floor(sum(pass_rate * w) / sum(w)) AS INTEGER) AS compliance_score FROM ({RESULTS}) r
  JOIN {WEIGHT_SQL} v(t, rule_id, w) ON v.rule_id = r.rule_id GROUP BY 1)
SELECT *, CASE WHEN compliance_score < 70 THEN 'exposed' ELSE 'protected' END AS exposure, 99 - compliance_score AS gap,
  (SELECT count(*) FROM s WHERE compliance_score < 99) AS gaps, (SELECT CAST(floor(avg(compliance_score)) AS INTEGER) FROM s) AS overall FROM s WHERE compliance_score < 99
""")
def compliance(t: Tables) -> DataFrame:
    weights = t.spark.createDataFrame([(r, w) for _, r, w in WEIGHTS], "rule_id string, weight int")
    scores = cut(score.compliance_score(results(t), weights))
    found = score.gaps(score.exposure(scores, limit=70), 99)
    return found.withColumns({"gaps": score.gap_summary(found).select("gaps").scalar(), "overall": score.overall(scores, "compliance_score").scalar()})


@query("c11_improvement_paths", f"""
WITH c(table_name, step, rule_id, action) AS (VALUES ('orders', 1, 'null_check:o_totalprice', 'fill prices'), ('orders', 2, 'fk:o_custkey', 'link customers'), ('lineitem', 1, 'unique:line', 'drop repeats'),
  ('lineitem', 2, 'fk:l_orderkey', 'link orders'))
SELECT c.table_name, 'bronze_to_silver' AS transition, step, c.rule_id, action, pass_rate FROM c JOIN ({RESULTS}) r ON r.table_name = c.table_name AND r.rule_id = c.rule_id WHERE status <> 'PASS'
""")
def paths(t: Tables) -> DataFrame:
    nested = t.spark.createDataFrame([
        ("orders", "bronze_to_silver", [("null_check:o_totalprice", "fill prices"), ("fk:o_custkey", "link customers")]),
        ("lineitem", "bronze_to_silver", [("unique:line", "drop repeats"), ("fk:l_orderkey", "link orders")])],
        "table_name string, transition string, steps array<struct<rule_id string, action string>>")
    return score.improvement_paths(results(t), score.expand_catalogue(nested))


@query("f8_f15_required_fields", outcome_sql("""
SELECT 'customer' AS table_name, 'kyc_completeness' AS rule_id, count(*) AS rows,
  count(*) FILTER (NOT (c_nationkey IS NOT NULL AND c_name IS NOT NULL AND regexp_matches(c_name, '^Customer#[0-9]+$'))) AS failed FROM {customer_dirty}"""))
def required(t: Tables) -> DataFrame:
    return R.run_rules(t.customer_dirty, "customer", [R.all_present("kyc_completeness", ["c_nationkey", "c_name"], {"c_name": "^Customer#[0-9]+$"})])


@query("f12_claim_integrity", outcome_sql("""
SELECT 'lineitem' AS table_name, 'claim_integrity' AS rule_id, count(*) AS rows, count(*) FILTER (NOT (
  l_extendedprice * (1 - l_discount) <= o_totalprice AND regexp_matches(CAST(1000000000 + l_suppkey AS VARCHAR), '^[12][0-9]{9}$') AND l_shipdate >= o_orderdate
  AND (l_returnflag <> 'R' OR l_linestatus = 'F'))) AS failed
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""".replace("{9}", "{{9}}").replace("{{9}}", "{9}")))
def claims(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    claim = joined.select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid_amount"), F.col("o_totalprice").alias("billed_amount"),
                          (1000000000 + F.col("l_suppkey")).cast("string").alias("npi"), F.col("l_shipdate").alias("claim_date"), F.col("o_orderdate").alias("service_date"),
                          F.when(F.col("l_returnflag") == "R", "DENIED").otherwise("PAID").alias("claim_status"),
                          F.when(F.col("l_linestatus") == "F", F.lit("late")).alias("denial_reason"))
    return R.run_rules(claim, "lineitem", [R.claim_rule()])


@query("f14_duplicate_people", outcome_sql("""
SELECT 'customer' AS table_name, 'patient_dedup_mpi' AS rule_id, count(*) AS rows, count(*) FILTER (n > 1) AS failed
FROM (SELECT count(*) OVER (PARTITION BY lower(c_name)) AS n FROM {customer_dirty})"""))
def duplicates(t: Tables) -> DataFrame:
    return R.run_rules(t.customer_dirty.withColumn("mrn", F.lower("c_name")), "customer", [R.Unique("patient_dedup_mpi", ["mrn"])])


@query("f20_timeliness", outcome_sql("""
SELECT 'lineitem' AS table_name, 'sar_timeliness' AS rule_id, count(*) AS rows,
  count(*) FILTER (l_returnflag = 'R' AND (l_linestatus = 'O' OR date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 30)) AS failed
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""))
def timely(t: Tables) -> DataFrame:
    filed = dated(t).withColumn("filed", F.when(F.col("l_linestatus") != "O", F.col("l_shipdate")))
    return R.run_rules(filed, "lineitem", [R.timeliness_rule("sar_timeliness", "o_orderdate", "filed", F.col("l_returnflag") == "R", 30)])


@query("f21_bank_codes", outcome_sql("""
SELECT 'supplier' AS table_name, 'bic:code' AS rule_id, count(*) AS rows, count(*) FILTER (NOT CASE WHEN s_acctbal < 0 THEN s_nationkey < 5
  ELSE regexp_matches(CASE WHEN s_nationkey < 20 THEN 'BANK' ELSE 'BNK' END || 'DE' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0'), '^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$') END) AS failed FROM supplier"""))
def bank_codes(t: Tables) -> DataFrame:
    code = F.concat(F.when(F.col("s_nationkey") < 20, "BANK").otherwise("BNK"), F.lit("DE"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))
    banks = t.supplier.select(F.when(F.col("s_acctbal") >= 0, code).alias("code"), F.when(F.col("s_nationkey") < 5, "US").otherwise("DE").alias("country"))
    return R.run_rules(banks, "supplier", [R.bic_rule("code", "country")])


@query("f2bis_issue_counts", outcome_sql("""
SELECT 'orders' AS table_name, 'missing_rate' AS rule_id, count(*) AS rows, count(*) FILTER (o_orderstatus IN ('F', 'O') AND o_totalprice IS NULL) AS failed FROM {orders_dirty}
UNION ALL SELECT 'orders', 'negative_balance', count(*), count(*) FILTER (NOT coalesce(o_totalprice >= 0 OR o_orderstatus = 'P', false)) FROM {orders_dirty}
UNION ALL SELECT 'orders', 'future_dated', count(*), count(*) FILTER (o_orderdate > TIMESTAMP '2001-01-01') FROM {orders_dirty}
UNION ALL SELECT 'orders', 'unlinked', count(*), count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)) FROM {orders_dirty}
"""))
def issues(t: Tables) -> DataFrame:
    return R.run_rules(t.orders_dirty, "orders", [
        R.implies_rule("missing_rate", F.col("o_orderstatus").isin("F", "O"), F.col("o_totalprice").isNotNull()),
        R.Row("negative_balance", (F.col("o_totalprice") >= 0) | (F.col("o_orderstatus") == "P")),
        R.Row("future_dated", ~fx.is_future("o_orderdate", "2001-01-01")),
        R.Exists("unlinked", ["o_custkey"], t.customer.where("c_acctbal >= 0"), ["c_custkey"], null_ok=False)])


@query("d3_customer_risk", """
SELECT c_custkey AS customer_id, CASE WHEN c_nationkey IS NULL THEN 66 ELSE 100 END AS kyc_score, c_mktsegment = 'MACHINERY' AS pep, coalesce(h, 0) AS sanctions_hits, coalesce(n, 0) AS accounts,
  coalesce(date_diff('day', first, DATE '2001-08-02'), -1) AS vintage_days,
  CASE WHEN coalesce(h, 0) > 0 OR c_mktsegment = 'MACHINERY' THEN 'HIGH' WHEN c_nationkey IS NULL THEN 'MEDIUM' ELSE 'LOW' END AS cdd_tier
FROM {customer_dirty} LEFT JOIN (SELECT o_custkey AS a, count(*) AS n, min(o_orderdate)::DATE AS first FROM orders GROUP BY 1) ON a = c_custkey
LEFT JOIN (SELECT o_custkey AS b, count(*) AS h FROM orders WHERE o_totalprice > 450000 GROUP BY 1) ON b = c_custkey
""")
def risk(t: Tables) -> DataFrame:
    people = t.customer_dirty.withColumns({"customer_id": F.col("c_custkey"), "pep_flag": (F.col("c_mktsegment") == "MACHINERY").cast("int")})
    accounts = t.orders.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("opened_date"))
    hits = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("customer_id"))
    return B.customer_risk(people, accounts, hits, ["c_name", "c_nationkey", "c_acctbal"], "2001-08-02").withColumn(
        "vintage_days", F.coalesce("vintage_days", F.lit(-1)))


@query("h9_comorbidity", """
WITH c AS (SELECT DISTINCT o_custkey, replace(o_orderpriority, '-', '') AS code FROM orders),
w(prefix, grp, weight, chronic) AS (VALUES ('1', 'urgent', 3, true), ('2H', 'high', 2, true), ('3ME', 'medium', 1, false), ('1URG', 'urgent', 3, true)),
g AS (SELECT o_custkey, grp, max(weight) AS weight, bool_or(chronic) AS chronic FROM c JOIN w ON starts_with(code, prefix) GROUP BY 1, 2)
SELECT c_custkey, coalesce(count(grp) FILTER (chronic), 0) AS chronic_count, CAST(coalesce(sum(weight), 0) AS BIGINT) AS comorbidity_index
FROM customer LEFT JOIN g ON o_custkey = c_custkey GROUP BY 1
""")
def comorbidity(t: Tables) -> DataFrame:
    people = t.customer.select(F.col("c_custkey").alias("patient_id"), F.lit("1950-01-01").alias("dob"))
    found = t.orders.select(F.col("o_custkey").alias("patient_id"), F.regexp_replace("o_orderpriority", "-", "").alias("icd10_code"))
    weights = t.spark.createDataFrame([("1", "urgent", 3, True), ("2H", "high", 2, True), ("3ME", "medium", 1, False), ("1URG", "urgent", 3, True)],
                                      "prefix string, grp string, weight int, chronic boolean")
    return C.patient_features(people, found, weights, "2024-01-01").select(F.col("patient_id").alias("c_custkey"), "chronic_count", "comorbidity_index")


@query("h14_branch_ratio", f"""
WITH l AS (SELECT o_custkey, sum({D('o_totalprice')}) AS loan FROM orders GROUP BY 1)
SELECT c_nationkey, CAST(sum({D('c_acctbal')}) AS DOUBLE) AS deposits, CAST(coalesce(sum(loan), 0) AS DOUBLE) AS loans FROM customer LEFT JOIN l ON o_custkey = c_custkey GROUP BY 1
""")
def branch(t: Tables) -> DataFrame:
    accounts = t.customer.select(F.col("c_custkey").alias("account_id"), "c_nationkey", F.col("c_acctbal").alias("balance"))
    loans = t.orders.select(F.col("o_custkey").alias("account_id"), F.col("o_totalprice").alias("outstanding_balance"))
    return B.branch_features(accounts, loans, "c_nationkey").select("c_nationkey", F.col("deposits").cast("double").alias("deposits"), F.col("loans").cast("double").alias("loans"))


@query("h17_medication_features", """
WITH d AS (SELECT DISTINCT o_custkey, unnest(range(0, 46)) + date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day FROM orders),
c AS (SELECT o_custkey, count(*) AS covered, max(day) - min(day) + 1 AS period FROM d GROUP BY 1)
SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') AS active_drugs, count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') >= 4 AS polypharmacy,
  bool_or(o_orderpriority = '1-URGENT') AS high_risk, round(CAST(max(covered) AS DOUBLE) / max(period), 4) AS adherence FROM orders JOIN c USING (o_custkey) GROUP BY 1
""")
def medication(t: Tables) -> DataFrame:
    meds = t.orders.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("drug_name"), F.col("o_orderpriority").alias("ndc_code"),
                           F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("DONE").alias("status"), F.col("o_orderdate").alias("start_date"),
                           F.date_add(F.col("o_orderdate").cast("date"), 45).alias("end_date"), F.col("o_orderkey").alias("medication_id"))
    risky = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderpriority").alias("ndc_code"))
    return C.medication_features(meds, risky, 4).withColumnRenamed("patient_id", "o_custkey")


@query("h19_claims_by_payer", f"""
WITH e AS (SELECT c_mktsegment AS payer, o_custkey, sum({D('o_totalprice')}) AS cost, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS denied FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT payer, CAST(sum(n) AS BIGINT) AS claims, CAST(sum(denied) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS denial_rate, CAST(sum(cost) AS DOUBLE) / count(*) AS cost_per_encounter FROM e GROUP BY 1
""")
def payers(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return C.claim_features(joined.select(F.col("c_mktsegment").alias("payer"), F.col("o_custkey").alias("encounter_id"), F.col("o_totalprice").alias("paid_amount"),
                                          F.when(F.col("o_orderstatus") == "P", "DENIED").otherwise("PAID").alias("claim_status")))


@query("g2_column_impact", """
WITH RECURSIVE e(src, dst) AS (SELECT DISTINCT 'raw.' || event_type, 'silver.' || lang FROM events, (SELECT DISTINCT lang FROM documents) WHERE length(event_type) > length(lang) + 2
  UNION SELECT DISTINCT 'silver.' || lang, 'gold.' || source FROM documents),
r AS (SELECT 'raw.' || min(event_type) AS node, 0 AS depth FROM events WHERE length(event_type) > 4 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node)
SELECT node, min(depth) AS depth FROM r GROUP BY 1
""")
def column_impact(t: Tables) -> DataFrame:
    kinds = t.events.select("event_type").distinct().withColumn("n", F.length("event_type"))
    langs = t.documents.select("lang").distinct().withColumn("m", F.length("lang"))
    # each source name feeds the languages shorter than it by more than two letters
    fed = kinds.withColumn("m", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") - 3, F.lit(1))))).where("n > m + 2").join(langs, "m")
    edges = fed.select(F.concat(F.lit("raw."), "event_type").alias("src"), F.concat(F.lit("silver."), "lang").alias("dst")).unionByName(
        t.documents.select(F.concat(F.lit("silver."), "lang").alias("src"), F.concat(F.lit("gold."), "source").alias("dst")).distinct())
    start = t.events.where(F.length("event_type") > 4).agg(F.concat(F.lit("raw."), F.min("event_type")).alias("node"))
    return graph.impact(edges, start)


@query("g6_key_drift", """
WITH a AS (SELECT DISTINCT 'user_' || user_id AS c, 'late' AS v FROM events WHERE ts < TIMESTAMP '2024-01-01 08:00:00'), b AS (SELECT DISTINCT 'user_' || user_id AS c FROM events WHERE ts >= TIMESTAMP '2024-01-30 08:00:00')
SELECT coalesce(a.c, b.c) AS column_name, CASE WHEN a.c IS NULL THEN 'added' ELSE 'removed' END AS change FROM a FULL JOIN b ON a.c = b.c WHERE a.c IS NULL OR b.c IS NULL
""")
def key_drift(t: Tables) -> DataFrame:
    keys = lambda df: df.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("column_name")).distinct().withColumn("data_type", F.lit("double"))
    return G.schema_drift(keys(t.events.where("ts < TIMESTAMP_NTZ '2024-01-01 08:00:00'")), keys(t.events.where("ts >= TIMESTAMP_NTZ '2024-01-30 08:00:00'"))).select("column_name", "change")
