"""Readiness scores and the scorecard."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from assay.checks.registry import Tables, query
from assay.operators import rules as R, score

AS_OF = "2001-08-02"


def rate_sql(passed: str, rows: str) -> str:
    """One decimal, half up, by integer division, as the rule engine does it."""
    return f"((2000 * ({passed}) + greatest({rows}, 1)) // (2 * greatest({rows}, 1))) / 10.0::DOUBLE"


def outcome_sql(counts: str) -> str:
    """Full rule outcome from a SELECT that yields table_name, rule_id, rows, failed."""
    return f"""
SELECT table_name, rule_id, rows, failed, rows - failed AS passed, {rate_sql('rows - failed', 'rows')} AS pass_rate,
       CASE WHEN rows > 0 AND 100 * (rows - failed) >= 95 * rows THEN 'PASS'
            WHEN rows > 0 AND 100 * (rows - failed) >= 80 * rows THEN 'WARN' ELSE 'FAIL' END AS status,
       CASE WHEN failed = 0 THEN 'info' WHEN 10 * failed < rows THEN 'warn' ELSE 'error' END AS severity
FROM ({counts})"""


def factor_spec(t: Tables, table: str) -> score.FactorSpec:
    return {
        "orders": score.FactorSpec(["o_custkey", "o_totalprice", "o_orderstatus"], ["o_orderkey"], "o_orderdate", AS_OF, 1000,
                                   [("o_custkey", t.customer, "c_custkey")]),
        "lineitem": score.FactorSpec(["l_orderkey", "l_quantity"], ["l_orderkey", "l_linenumber"], "l_shipdate", AS_OF, 1000,
                                     [("l_orderkey", t.orders, "o_orderkey"), ("l_partkey", t.part, "p_partkey")]),
        "customer": score.FactorSpec(["c_name", "c_nationkey"], ["c_name"], None, None, 0,
                                     [("c_nationkey", t.nation, "n_nationkey")]),
    }[table]


FACTORS_SQL = {
    "orders": """
SELECT 'orders' AS table_name, count(*) AS rows,
  (10000 * (count(o_custkey) + count(o_totalprice) + count(o_orderstatus)) // (3 * count(*))) / 100.0::DOUBLE AS completeness,
  (10000 * count(DISTINCT o_orderkey) // count(*)) / 100.0::DOUBLE AS uniqueness,
  (10000 * count(*) FILTER (date_diff('day', o_orderdate::DATE, DATE '2001-08-02') <= 1000) // count(*)) / 100.0::DOUBLE AS freshness,
  (10000 * ((min(o_orderkey) < max(o_orderkey))::INT + (min(o_custkey) < max(o_custkey))::INT + (min(o_orderstatus) < max(o_orderstatus))::INT
    + (min(o_totalprice) < max(o_totalprice))::INT + (min(o_orderdate) < max(o_orderdate))::INT + (min(o_orderpriority) < max(o_orderpriority))::INT) // 6) / 100.0::DOUBLE AS cardinality,
  (10000 * count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer)) // count(*)) / 100.0::DOUBLE AS referential
FROM {orders_dirty}""",
    "lineitem": """
SELECT 'lineitem' AS table_name, count(*) AS rows,
  (10000 * (count(l_orderkey) + count(l_quantity)) // (2 * count(*))) / 100.0::DOUBLE AS completeness,
  (10000 * (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) // count(*)) / 100.0::DOUBLE AS uniqueness,
  (10000 * count(*) FILTER (date_diff('day', l_shipdate::DATE, DATE '2001-08-02') <= 1000) // count(*)) / 100.0::DOUBLE AS freshness,
  (10000 * (SELECT sum((lo < hi)::INT) FROM (
     SELECT min(l_orderkey)::VARCHAR AS lo, max(l_orderkey)::VARCHAR AS hi FROM lineitem WHERE false UNION ALL
     SELECT CASE WHEN min(l_orderkey) < max(l_orderkey) THEN 'a' ELSE 'b' END, 'b' FROM lineitem UNION ALL
     SELECT CASE WHEN min(l_partkey) < max(l_partkey) THEN 'a' ELSE 'b' END, 'b' FROM lineitem UNION ALL
     SELECT CASE WHEN min(l_suppkey) < max(l_suppkey) THEN 'a' ELSE 'b' END, 'b' FROM lineitem UNION ALL
     SELECT CASE WHEN min(l_linenumber) < max(l_linenumber) THEN 'a' ELSE 'b' END, 'b' FROM lineitem UNION ALL
     SELECT CASE WHEN min(l_quantity) < max(l_quantity) THEN 'a' ELSE 'b' END, 'b' FROM lineitem UNION ALL
     SELECT CASE WHEN min(l_extendedprice) < max(l_extendedprice) THEN 'a' ELSE 'b' END, 'b' FROM lineitem UNION ALL
     SELECT CASE WHEN min(l_discount) < max(l_discount) THEN 'a' ELSE 'b' END, 'b' FROM lineitem UNION ALL
     SELECT CASE WHEN min(l_tax) < max(l_tax) THEN 'a' ELSE 'b' END, 'b' FROM lineitem UNION ALL
     SELECT CASE WHEN min(l_returnflag) < max(l_returnflag) THEN 'a' ELSE 'b' END, 'b' FROM lineitem UNION ALL
     SELECT CASE WHEN min(l_linestatus) < max(l_linestatus) THEN 'a' ELSE 'b' END, 'b' FROM lineitem UNION ALL
     SELECT CASE WHEN min(l_shipdate) < max(l_shipdate) THEN 'a' ELSE 'b' END, 'b' FROM lineitem)) // 11)::BIGINT / 100.0::DOUBLE AS cardinality,
  (10000 * (count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM orders)) + count(*) FILTER (l_partkey IN (SELECT p_partkey FROM part)))
     // (2 * count(*))) / 100.0::DOUBLE AS referential
FROM lineitem""",
    "customer": """
SELECT 'customer' AS table_name, count(*) AS rows,
  (10000 * (count(c_name) + count(c_nationkey)) // (2 * count(*))) / 100.0::DOUBLE AS completeness,
  (10000 * count(DISTINCT c_name) // count(*)) / 100.0::DOUBLE AS uniqueness,
  100.0::DOUBLE AS freshness,
  (10000 * ((min(c_custkey) < max(c_custkey))::INT + (min(c_name) < max(c_name))::INT + (min(c_nationkey) < max(c_nationkey))::INT
    + (min(c_acctbal) < max(c_acctbal))::INT + (min(c_mktsegment) < max(c_mktsegment))::INT) // 5) / 100.0::DOUBLE AS cardinality,
  (10000 * count(*) FILTER (c_nationkey IN (SELECT n_nationkey FROM nation)) // count(*)) / 100.0::DOUBLE AS referential
FROM {customer_dirty}""",
}
SCORE_SQL = """CAST(floor((30 * completeness::DECIMAL(9,4) + 20 * uniqueness::DECIMAL(9,4) + 20 * freshness::DECIMAL(9,4)
  + 15 * cardinality::DECIMAL(9,4) + 15 * referential::DECIMAL(9,4)) / 100) AS INTEGER)"""


def dirty(t: Tables, table: str) -> DataFrame:
    return {"orders": t.orders_dirty, "lineitem": t.lineitem, "customer": t.customer_dirty}[table]


@query("c1_c4_readiness", f"SELECT *, {SCORE_SQL} AS score FROM (" + " UNION ALL ".join(FACTORS_SQL.values()) + ")")
def readiness(t: Tables) -> DataFrame:
    factors = reduce(DataFrame.unionByName, [score.measure_factors(dirty(t, n), n, factor_spec(t, n)) for n in FACTORS_SQL])
    return score.readiness(factors, score.CORE_WEIGHTS)


def scorecard_rules(t: Tables) -> dict[str, list]:
    return {
        "orders": [R.null_rule("o_totalprice"), R.range_rule("o_totalprice", lo=0), R.in_rule("o_orderstatus", ["F", "O", "P"]),
                   R.Unique("unique:o_orderkey", ["o_orderkey"]), R.Exists("fk:o_custkey", ["o_custkey"], t.customer, ["c_custkey"])],
        "lineitem": [R.null_rule("l_quantity"), R.range_rule("l_quantity", lo=1, hi=50),
                     R.Unique("unique:line", ["l_orderkey", "l_linenumber"]),
                     R.Exists("fk:l_orderkey", ["l_orderkey"], t.orders, ["o_orderkey"])],
        "customer": [R.null_rule("c_nationkey"), R.range_rule("c_acctbal", lo=0),
                     R.Exists("fk:c_nationkey", ["c_nationkey"], t.nation, ["n_nationkey"])],
    }


BAD_SQL = {
    "orders": """
SELECT 'orders' AS table_name, sum((f > 0)::INT)::BIGINT AS quarantined, sum(f)::BIGINT AS failures FROM (
  SELECT (o_totalprice IS NULL)::INT + coalesce(o_totalprice < 0, false)::INT + (o_orderstatus NOT IN ('F','O','P'))::INT
       + (count(*) OVER (PARTITION BY o_orderkey) > 1)::INT + (o_custkey NOT IN (SELECT c_custkey FROM customer))::INT AS f
  FROM {orders_dirty})""",
    "lineitem": """
SELECT 'lineitem' AS table_name, sum((f > 0)::INT)::BIGINT AS quarantined, sum(f)::BIGINT AS failures FROM (
  SELECT (l_quantity IS NULL)::INT + (l_quantity < 1 OR l_quantity > 50)::INT
       + (count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1)::INT + (l_orderkey NOT IN (SELECT o_orderkey FROM orders))::INT AS f
  FROM lineitem)""",
    "customer": """
SELECT 'customer' AS table_name, sum((f > 0)::INT)::BIGINT AS quarantined, sum(f)::BIGINT AS failures FROM (
  SELECT (c_nationkey IS NULL)::INT + (c_acctbal < 0)::INT + coalesce(c_nationkey NOT IN (SELECT n_nationkey FROM nation), false)::INT AS f
  FROM {customer_dirty})""",
}


@query("table_scorecard", f"""
WITH f AS ({' UNION ALL '.join(FACTORS_SQL.values())}), b AS ({' UNION ALL '.join(BAD_SQL.values())})
SELECT f.*, {SCORE_SQL} AS score, quarantined, failures, rows - quarantined AS gold_rows FROM f JOIN b USING (table_name)
""")
def scorecard(t: Tables) -> DataFrame:
    rules = scorecard_rules(t)
    cards = []
    for n in FACTORS_SQL:
        lines = R.key_lines(dirty(t, n), rules[n], score.factor_keys(factor_spec(t, n)))  # one scan for all keys
        bad = R.quarantine_summary(dirty(t, n), n, rules[n], lines).select(F.struct("quarantined", "failures", "gold_rows").alias("b")).scalar()
        factors = score.measure_factors(dirty(t, n), n, factor_spec(t, n), lines).withColumn("b", bad)
        cards.append(factors.select(*[c for c in factors.columns if c != "b"], "b.*"))
    return score.readiness(reduce(DataFrame.unionByName, cards), score.CORE_WEIGHTS)


@query("c6_layer_scores", """
WITH bronze AS (SELECT * FROM lineitem),
silver AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
   ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1),
gold AS (SELECT s.* FROM silver s JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate),
s AS (
""" + " UNION ALL ".join(f"""
SELECT 'lineitem' AS table_name, '{x}' AS layer, CAST(floor(({rate_sql('(SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM ' + x + '))', 'count(*)')}
   + {rate_sql('count(*) FILTER (l_shipdate >= o_orderdate)', 'count(*)')}) / 2) AS INTEGER) AS score
FROM {x} JOIN orders ON o_orderkey = l_orderkey""" for x in ("bronze", "silver", "gold")) + """)
SELECT table_name, layer, score, coalesce(score - lag(score) OVER (ORDER BY layer = 'gold', layer = 'silver'), 0) AS change FROM s
""")
def layer_scores(t: Tables) -> DataFrame:
    from assay.operators.ordered import first_rows
    bronze = t.lineitem
    silver = first_rows(bronze, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    dated = lambda df: df.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    gold = dated(silver).where("l_shipdate >= o_orderdate").select(*bronze.columns)
    parts = []
    for name, df in (("bronze", bronze), ("silver", silver), ("gold", gold)):
        # one line per key carries everything both rules need
        keys = dated(df).groupBy("l_orderkey", "l_linenumber").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_shipdate") >= F.col("o_orderdate")).alias("ok"))
        parts.append(keys.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.sum("ok").alias("ok")).select(
            F.lit("lineitem").alias("table_name"), F.lit(name).alias("layer"),
            F.floor((R.pass_rate(F.col("keys"), F.col("rows")) + R.pass_rate(F.col("ok"), F.col("rows"))) / 2).cast("int").alias("score")))
    return score.layer_scores(reduce(DataFrame.unionByName, parts))


@query("c9_top_types_per_user", """
SELECT * FROM (SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank
  FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE rank <= 3
""")
def top_types(t: Tables) -> DataFrame:
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return score.top_k(counts, ["user_id"], [F.col("n").desc(), "event_type"], 3)
