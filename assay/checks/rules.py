"""Data-quality rules on the test tables."""

from pyspark.sql import DataFrame, functions as F

from assay.checks.registry import Tables, query
from assay.checks.scores import outcome_sql, scorecard_rules
from assay.functions import patterns
from assay.operators import rules as R
from assay.operators.ordered import exact_quantiles

ORDERS_RULES = """
SELECT 'orders' AS table_name, 'null_check:o_totalprice' AS rule_id, count(*) AS rows, count(*) FILTER (o_totalprice IS NULL) AS failed FROM {orders_dirty}
UNION ALL SELECT 'orders', 'range:o_totalprice', count(*), count(*) FILTER (o_totalprice < 0) FROM {orders_dirty}
UNION ALL SELECT 'orders', 'accepted:o_orderstatus', count(*), count(*) FILTER (o_orderstatus NOT IN ('F','O','P')) FROM {orders_dirty}
UNION ALL SELECT 'orders', 'unique:o_orderkey', count(*), count(*) FILTER (n > 1) FROM (SELECT count(*) OVER (PARTITION BY o_orderkey) AS n FROM {orders_dirty})
UNION ALL SELECT 'orders', 'fk:o_custkey', count(*), count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM {orders_dirty}
"""
LINEITEM_RULES = """
SELECT 'lineitem' AS table_name, 'null_check:l_quantity' AS rule_id, count(*) AS rows, count(*) FILTER (l_quantity IS NULL) AS failed FROM lineitem
UNION ALL SELECT 'lineitem', 'range:l_quantity', count(*), count(*) FILTER (l_quantity < 1 OR l_quantity > 50) FROM lineitem
UNION ALL SELECT 'lineitem', 'unique:line', count(*), count(*) FILTER (n > 1) FROM (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
UNION ALL SELECT 'lineitem', 'fk:l_orderkey', count(*), count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem
"""


def results(t: Tables) -> DataFrame:
    rules = scorecard_rules(t)
    return R.run_rules(t.orders_dirty, "orders", rules["orders"]).unionByName(R.run_rules(t.lineitem, "lineitem", rules["lineitem"]))


@query("f0_f2_rule_results", outcome_sql(ORDERS_RULES + " UNION ALL " + LINEITEM_RULES))
def rule_results(t: Tables) -> DataFrame:
    return results(t)


@query("f25_remediation", f"""
SELECT table_name, count(*) FILTER (status <> 'PASS') AS open_rules, min(pass_rate) AS worst_rate
FROM ({outcome_sql(ORDERS_RULES + ' UNION ALL ' + LINEITEM_RULES)}) GROUP BY 1 HAVING count(*) FILTER (status <> 'PASS') > 0
""")
def remediation(t: Tables) -> DataFrame:
    return R.remediation(results(t))


JUDGED = """
SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice IS NULL THEN 'null_check:o_totalprice' END,
  CASE WHEN o_totalprice < 0 THEN 'range:o_totalprice' END, CASE WHEN o_orderstatus NOT IN ('F','O','P') THEN 'accepted:o_orderstatus' END,
  CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 'fk:o_custkey' END) AS failed_rules FROM {orders_dirty}
"""


@query("a8_quarantined_rows", f"SELECT * FROM ({JUDGED}) WHERE failed_rules <> ''")
def quarantined_rows(t: Tables) -> DataFrame:
    _, bad = R.quarantine(t.orders_dirty, scorecard_rules(t)["orders"])
    return bad.select("o_orderkey", F.array_join("failed_rules", ",").alias("failed_rules"))


@query("f0c_quarantine_summary", """
SELECT 'lineitem' AS table_name, count(*) AS rows, count(*) FILTER (f > 0) AS quarantined, sum(f)::BIGINT AS failures,
       count(*) FILTER (f = 0) AS gold_rows, greatest(count(*) - sum(f), 0)::BIGINT AS gold_rows_double_counted
FROM (SELECT (l_shipdate < o_orderdate)::INT + (count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1)::INT AS f
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
""")
def quarantine_summary(t: Tables) -> DataFrame:
    return R.quarantine_summary(dated(t), "lineitem", [
        R.date_rule("date_coherence", [("o_orderdate", "l_shipdate")]), R.Unique("unique:line", ["l_orderkey", "l_linenumber"])])


def dated(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"))


@query("f1_null_threshold", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, 100.0 * (count(*) - count({c})) <= count(*) * 5.0 AS ok FROM {{orders_dirty}}"
    for c in ("o_custkey", "o_totalprice", "o_orderstatus")))
def null_threshold(t: Tables) -> DataFrame:
    return R.null_share_ok(t.orders_dirty, ["o_custkey", "o_totalprice", "o_orderstatus"], 5.0)


@query("f3_range_from_percentiles", """
WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS rn, count(*) OVER () AS n FROM orders),
     b AS (SELECT max(v) FILTER (rn = greatest(ceil(CAST(0.01 AS DOUBLE) * n), 1)) AS lo, max(v) FILTER (rn = ceil(CAST(0.99 AS DOUBLE) * n)) AS hi FROM o)
SELECT lo, hi, count(*) AS rows, count(*) FILTER (o_totalprice < lo OR o_totalprice > hi) AS failed FROM orders, b GROUP BY lo, hi
""")
def percentile_range(t: Tables) -> DataFrame:
    q = exact_quantiles(t.orders, "o_totalprice", {"lo": 0.01, "hi": 0.99})
    bounds = q.agg(F.struct(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in ("lo", "hi")]).alias("b")).scalar()
    marked = t.orders.select("o_totalprice", bounds.alias("b"))
    return marked.groupBy("b").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((F.col("o_totalprice") < F.col("b.lo")) | (F.col("o_totalprice") > F.col("b.hi"))).alias("failed"),
    ).select("b.lo", "b.hi", "rows", "failed")


@query("f4_regex", f"""
SELECT 'customer' AS table_name, 'regex:c_name' AS rule_id, count(*) AS rows,
       count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]{{9}}$')) AS failed FROM {{customer_dirty}}
UNION ALL SELECT 'documents', 'no_email', count(*), count(*) FILTER (regexp_matches(text, '{patterns.EMAIL}')) FROM documents
UNION ALL SELECT 'documents', 'no_ip', count(*), count(*) FILTER (regexp_matches(text, '{patterns.IP}')) FROM documents
UNION ALL SELECT 'documents', 'no_phone', count(*), count(*) FILTER (regexp_matches(text, '{patterns.PHONE}')) FROM documents
""".replace("{{", "{").replace("}}", "}"))
def regex(t: Tables) -> DataFrame:
    a = R.run_rules(t.customer_dirty, "customer", [R.regex_rule("c_name", r"^Customer#[0-9]{9}$")])
    b = R.run_rules(t.documents, "documents", [
        R.Row("no_email", ~F.col("text").rlike(patterns.EMAIL)), R.Row("no_ip", ~F.col("text").rlike(patterns.IP)),
        R.Row("no_phone", ~F.col("text").rlike(patterns.PHONE))])
    return a.unionByName(b).select("table_name", "rule_id", "rows", "failed")


@query("f5_foreign_keys", outcome_sql("""
SELECT 'documents' AS table_name, 'fk:labels' AS rule_id, count(*) AS rows, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS failed FROM documents
UNION ALL SELECT 'orders', 'fk:o_custkey', count(*), count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM {orders_dirty}
UNION ALL SELECT 'customer', 'fk:c_nationkey', count(*), count(*) FILTER (c_nationkey IS NULL) FROM {customer_dirty}
"""))
def foreign_keys(t: Tables) -> DataFrame:
    a = R.run_rules(t.documents, "documents", [R.Exists("fk:labels", ["doc_id"], t.labels, ["doc_id"])])
    b = R.run_rules(t.orders_dirty, "orders", [R.Exists("fk:o_custkey", ["o_custkey"], t.customer, ["c_custkey"])])
    c = R.run_rules(t.customer_dirty, "customer", [
        R.Exists("fk:c_nationkey", ["c_nationkey"], t.nation, ["n_nationkey"], null_ok=False)])
    return a.unionByName(b).unionByName(c)


@query("f6_volume", """
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows FROM events GROUP BY 1),
     w AS (SELECT *, avg(rows) OVER p AS m, stddev_pop(rows) OVER p AS s, count(*) OVER p AS seen FROM d
           WINDOW p AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT day, rows, round(coalesce(m, 0), 4) AS mean_before, round(coalesce(s, 0), 4) AS sd_before,
       coalesce(seen >= 2 AND abs(rows - m) > 1.5 * s, false) AS anomaly FROM w
""")
def volume(t: Tables) -> DataFrame:
    days = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    return R.volume_rule(days, "day", k=1.5).withColumns({
        "mean_before": F.round(F.coalesce("mean_before", F.lit(0.0)), 4), "sd_before": F.round(F.coalesce("sd_before", F.lit(0.0)), 4)})


@query("f7_freshness", """
SELECT count(*) AS rows, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest,
       min(CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts))) AS BIGINT)) AS age_seconds,
       count(*) FILTER (epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) > 86400) AS stale_rows,
       min(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts))) <= 86400 AS fresh FROM events
""")
def freshness(t: Tables) -> DataFrame:
    return R.freshness_rule(t.events, "ts", "2024-01-31 00:00:00").withColumn("newest", F.date_format("newest", "yyyy-MM-dd HH:mm:ss"))


@query("f9_code_validity", """
SELECT 'orders' AS table_name, 'code:o_orderpriority' AS rule_id, count(*) AS rows,
       count(*) FILTER (NOT (regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$') AND o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM'))) AS failed FROM orders
UNION ALL SELECT 'nation', 'code:n_name', count(*), count(*) FILTER (NOT regexp_matches(n_name, '^NATION_[0-9]$')) FROM nation
""")
def codes(t: Tables) -> DataFrame:
    a = R.run_rules(t.orders, "orders", [R.code_rule("o_orderpriority", "^[1-5]-[A-Z ]+$", ["1-URGENT", "2-HIGH", "3-MEDIUM"])])
    b = R.run_rules(t.nation, "nation", [R.code_rule("n_name", "^NATION_[0-9]$")])
    return a.unionByName(b).select("table_name", "rule_id", "rows", "failed")


@query("f10_range_flags", """
SELECT CASE WHEN p_size > 40 THEN CASE WHEN p_size > 48 THEN 'C' ELSE 'H' END
            WHEN p_size < 10 THEN CASE WHEN p_size > 0 THEN 'L' ELSE 'C' END ELSE 'N' END AS flag, count(*) AS n FROM part GROUP BY 1
""")
def range_flags(t: Tables) -> DataFrame:
    flag = R.lab_flag(F.col("p_size"), F.lit(10), F.lit(40), F.lit(48))
    return t.part.groupBy(flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("f11_dose_against_standard", """
WITH s AS (SELECT l_partkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS standard FROM lineitem GROUP BY 1)
SELECT 'lineitem' AS table_name, 'medication_safety' AS rule_id, count(*) AS rows,
       count(*) FILTER (NOT (l_quantity > 0 AND l_quantity <= 1.5::DOUBLE * standard)) AS failed FROM lineitem JOIN s USING (l_partkey)
""")
def dose(t: Tables) -> DataFrame:
    standard = t.lineitem.groupBy("l_partkey").agg(
        (F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("standard"))
    return R.run_rules(t.lineitem.join(standard, "l_partkey"), "lineitem", [R.dose_rule("l_quantity", "standard", 1.5)]).select(
        "table_name", "rule_id", "rows", "failed")


@query("f13_date_coherence", outcome_sql("""
SELECT 'lineitem' AS table_name, 'date_coherence' AS rule_id, count(*) AS rows,
       count(*) FILTER (l_shipdate < o_orderdate OR l_shipdate::DATE > DATE '2001-06-30') AS failed
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""))
def dates(t: Tables) -> DataFrame:
    return R.run_rules(dated(t), "lineitem", [
        R.date_rule("date_coherence", [("o_orderdate", "l_shipdate")], "2001-06-30", ["l_shipdate"])])


SPANS = {"24h": (86400, 6, 500.0), "7d": (604800, 25, 1500.0), "30d": (2592000, 80, 4000.0)}


@query("f16_velocity", """
WITH k AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS tick, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS amount FROM events GROUP BY 1, 2),
w AS (SELECT user_id, tick, n, CAST(amount AS DOUBLE) AS amount, """ + ", ".join(
    f"CAST(sum(n) OVER w{k} AS BIGINT) AS n_{k}, CAST(sum(amount) OVER w{k} AS DOUBLE) AS amount_{k}" for k in SPANS) + " FROM k WINDOW " + ", ".join(
    f"w{k} AS (PARTITION BY user_id ORDER BY tick RANGE BETWEEN {s - 1} PRECEDING AND CURRENT ROW)" for k, (s, _, _) in SPANS.items()) + """)
SELECT *, """ + ", ".join(f"n_{k} > {c} OR amount_{k} > {a} AS over_{k}" for k, (_, c, a) in SPANS.items()) + " FROM w")
def velocity(t: Tables) -> DataFrame:
    out = R.velocity_rule(t.events, "user_id", "ts", F.col("value").cast("decimal(18,2)"), SPANS)
    return out.withColumns({c: F.col(c).cast("double") for c in out.columns if c.startswith("amount")})


@query("f18_luhn", """
WITH s AS (SELECT CAST(o_orderkey AS VARCHAR) AS s FROM orders)
SELECT 'orders' AS table_name, 'luhn:number' AS rule_id, count(*) AS rows, count(*) FILTER (
  list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(s, length(s) - i + 1, 1) AS INT)
    ELSE CAST(substr(s, length(s) - i + 1, 1) AS INT) * 2 - CASE WHEN CAST(substr(s, length(s) - i + 1, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 <> 0) AS failed
FROM s""")
def luhn(t: Tables) -> DataFrame:
    numbers = t.orders.select(F.col("o_orderkey").cast("string").alias("number"))
    return R.run_rules(numbers, "orders", [R.luhn_rule("number")]).select("table_name", "rule_id", "rows", "failed")


@query("f19_aba_routing", """
WITH s AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS s FROM orders)
SELECT 'orders' AS table_name, 'aba:routing' AS rule_id, count(*) AS rows, count(*) FILTER ((""" + " + ".join(
    f"{w} * CAST(substr(s, {i + 1}, 1) AS INT)" for i, w in enumerate((3, 7, 1) * 3)) + """) % 10 <> 0) AS failed FROM s
UNION ALL SELECT 'orders', 'directory', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer))
""")
def aba(t: Tables) -> DataFrame:
    pad = lambda c: F.lpad(F.col(c).cast("string"), 9, "0").alias("routing")
    directory = t.customer.select(pad("c_custkey"))
    return R.run_rules(t.orders.select(pad("o_orderkey")), "orders", [
        R.aba_rule("routing"), R.Exists("directory", ["routing"], directory, ["routing"])]).select("table_name", "rule_id", "rows", "failed")


@query("f23_conditional_presence", """
SELECT 'orders' AS table_name, 'finished_has_price' AS rule_id, count(*) AS rows,
       count(*) FILTER (o_orderstatus = 'F' AND o_totalprice IS NULL) AS failed FROM {orders_dirty}
""")
def implies(t: Tables) -> DataFrame:
    return R.run_rules(t.orders_dirty, "orders", [R.implies_rule(
        "finished_has_price", F.col("o_orderstatus") == "F", F.col("o_totalprice").isNotNull())]).select(
        "table_name", "rule_id", "rows", "failed")


MEASURES_SQL = """count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
  round(CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_discount"""


def measures():
    dec = lambda c, s="decimal(18,2)": F.col(c).cast(s)
    return {
        "n": ("count",), "quantity": ("sum", dec("l_quantity")),
        "revenue": ("sum", dec("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - dec("l_discount", "decimal(4,2)"))),
        "avg_discount": ("avg", dec("l_discount")),
    }


def aggregate_query(name: str, mode: str, group: str, sets=None):
    gid = "" if mode == "plain" else ", CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS grouping_id"

    @query(name, f"SELECT l_returnflag, l_linestatus, {MEASURES_SQL}{gid} FROM lineitem GROUP BY {group}")
    def run(t: Tables) -> DataFrame:
        out = R.gold_aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], measures(), mode, sets)
        return out.withColumns({"quantity": F.col("quantity").cast("double"), "revenue": F.col("revenue").cast("double"),
                                "avg_discount": F.round("avg_discount", 6)})


aggregate_query("f24_gold_plain", "plain", "l_returnflag, l_linestatus")
aggregate_query("f24_gold_rollup", "rollup", "ROLLUP (l_returnflag, l_linestatus)")
aggregate_query("f24_gold_cube", "cube", "CUBE (l_returnflag, l_linestatus)")
aggregate_query("f24_gold_grouping_sets", "sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())",
                [["l_returnflag"], ["l_linestatus"], []])
