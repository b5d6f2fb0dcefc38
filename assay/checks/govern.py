"""Governance and target model."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from assay.checks.registry import Tables, query
from assay.operators import govern as G, graph, matching, model, profile

NAMES = ("orders", "lineitem", "customer", "events", "documents")


@query("g1_lineage", " UNION ALL ".join(f"""
SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS rows, '{a}/{n}' AS src, '{b}/{n}' AS dst, '{tr}' AS transform, {i} AS step"""
    for n in NAMES for i, (a, b, tr) in enumerate(G.DEFAULT_STEPS, 1)))
def lineage(t: Tables) -> DataFrame:
    return G.lineage(profile.table_counts({n: getattr(t, n) for n in NAMES}))


COLUMN_STEPS = [("revenue", ["l_extendedprice", "l_discount"], "revenue"), ("margin", ["revenue", "l_tax"], "margin"), ("ship month", ["l_shipdate"], "month")]


@query("g2_column_lineage", """
WITH RECURSIVE e(src, dst, transform) AS (VALUES ('l_extendedprice', 'revenue', 'revenue'), ('l_discount', 'revenue', 'revenue'), ('revenue', 'margin', 'margin'), ('l_tax', 'margin', 'margin'),
  ('l_shipdate', 'month', 'ship month')),
c AS (SELECT 'l_extendedprice' AS node, count(l_extendedprice) AS filled FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', count(l_tax) FROM lineitem UNION ALL SELECT 'l_shipdate', count(l_shipdate) FROM lineitem),
r AS (SELECT node AS origin, node FROM c UNION SELECT r.origin, e.dst FROM r JOIN e ON e.src = r.node)
SELECT origin, r.node, filled FROM r JOIN c ON c.node = r.origin WHERE origin <> r.node
""")
def column_steps(t: Tables) -> DataFrame:
    edges = G.column_lineage(t.spark, COLUMN_STEPS)
    sources = ["l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    filled = t.lineitem.agg(*[F.count(c).alias(c) for c in sources])
    long = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("origin"), F.col(c).alias("filled")) for c in sources])).alias("s")).select("s.*")
    reached = reduce(DataFrame.unionByName, [
        graph.impact(edges, t.spark.createDataFrame([(c,)], "node string")).where("depth > 0").select(F.lit(c).alias("origin"), "node") for c in sources])
    return reached.join(long, "origin")


@query("g6_schema_drift", """
SELECT 'c_nationkey' AS column_name, 'retyped' AS change, count(*) AS rows FROM customer UNION ALL SELECT 'c_mktsegment', 'removed', count(*) FROM customer
UNION ALL SELECT 'c_segment', 'added', count(*) FROM customer
""")
def drift(t: Tables) -> DataFrame:
    new = t.customer.withColumn("c_nationkey", F.col("c_nationkey").cast("bigint")).withColumnRenamed("c_mktsegment", "c_segment")
    rows = new.agg(F.count(F.lit(1))).scalar()
    return G.schema_drift(G.schema_rows(t.spark, t.customer.schema), G.schema_rows(t.spark, new.schema)).select("column_name", "change", rows.alias("rows"))


def row_edges(t: Tables) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (t.nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
            .unionByName(t.customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
            .unionByName(t.orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))))


@query("g3_impact", """
WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
r AS (SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region WHERE r_name = 'ASIA' UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node)
SELECT node, min(depth) AS depth FROM r GROUP BY 1
""")
def impact(t: Tables) -> DataFrame:
    start = t.region.where("r_name = 'ASIA'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.impact(row_edges(t), start)


WIDTH = {"orders": 6, "lineitem": 11, "customer": 5, "events": 6, "documents": 5}


@query("g4_catalogue", " UNION ALL ".join(f"""
SELECT '{n}' AS table_name, 'bronze' AS layer, {w} AS columns, (SELECT count(*) FROM {n}) AS rows""" for n, w in WIDTH.items()))
def catalogue(t: Tables) -> DataFrame:
    return G.catalogue(t.spark, {n: getattr(t, n) for n in WIDTH}, "bronze")


@query("g7_role_view", """
SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_name, c_mktsegment FROM customer
""")
def role_view(t: Tables) -> DataFrame:
    policy = {"analyst": {"c_custkey": "show", "c_name": "mask", "c_mktsegment": "show"}, "auditor": {"c_custkey": "show", "c_acctbal": "show"}}
    return G.role_view(t.customer, policy, "analyst")


@query("g8_consent", "SELECT doc_id, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0), false) AS consent FROM documents")
def consent(t: Tables) -> DataFrame:
    return G.apply_consent(t.documents, t.labels, "doc_id", (F.col("quality") == 1) & (F.col("toxic") == 0), keep=True).select("doc_id", "consent")


@query("g8_consenting_rows", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def consenting(t: Tables) -> DataFrame:
    return G.apply_consent(t.documents, t.labels, "doc_id", F.col("quality") == 1).select("doc_id", "lang")


@query("g9_access_report", """
SELECT strftime(ts, '%Y-%m-%d') AS period, user_id, count(*) AS accesses, count(*) FILTER (event_type = 'error') AS without_purpose,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY 1, 2
""")
def access(t: Tables) -> DataFrame:
    log = t.events.withColumn("purpose", F.when(F.col("event_type") != "error", F.col("event_type")))
    return G.access_report(log, "ts", "user_id", "purpose").withColumns({
        "period": F.date_format("period", "yyyy-MM-dd"), "first_ts": F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss"),
        "last_ts": F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss")})


@query("g10_without_agreement", """
SELECT o_custkey, o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem, (SELECT 1)
  WHERE l_orderkey = o_orderkey AND l_shipdate <= TIMESTAMP '1999-01-01' AND (l_returnflag = 'N' OR l_shipdate + INTERVAL 400 DAY >= TIMESTAMP '1999-01-01'))
""")
def agreements(t: Tables) -> DataFrame:
    deals = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("valid_from"),
                              F.when(F.col("l_returnflag") != "N", F.date_add(F.col("l_shipdate").cast("date"), 400)).alias("valid_to"))
    return G.consumers_without(t.orders, deals, "o_orderkey", F.lit("1999-01-01").cast("date")).select("o_custkey", "o_orderkey")


@query("g11_screening", """
WITH s AS (SELECT c_custkey, c_name AS name, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM {customer_dirty}),
     w AS (SELECT DISTINCT replace(s_name, 'Supplier', 'Customer') AS listed, trim(regexp_replace(lower(replace(s_name, 'Supplier', 'Customer')), '[^a-z0-9]+', ' ', 'g')) AS lk FROM supplier)
SELECT c_custkey, name, listed, levenshtein(k, lk) AS distance, CASE WHEN name = listed THEN 'exact' WHEN k = lk THEN 'normalised' ELSE 'fuzzy' END AS hit
FROM s JOIN w ON levenshtein(k, lk) <= 1
""")
def screening(t: Tables) -> DataFrame:
    listed = t.supplier.select(F.regexp_replace("s_name", "Supplier", "Customer").alias("listed_name"))
    return matching.screen(t.customer_dirty, "c_custkey", "c_name", listed, "listed_name", 1)


@query("g12_regimes", """
WITH r(event_type, regimes) AS (VALUES ('purchase', 'PCI / AML'), ('signup', 'KYC / GLBA / AML'), ('error', 'SOX')),
x AS (SELECT event_type, trim(unnest(string_split(regimes, '/'))) AS regime FROM r)
SELECT regime, count(*) AS n FROM events JOIN x USING (event_type) GROUP BY 1
""")
def regimes(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame([("purchase", "PCI / AML"), ("signup", "KYC / GLBA / AML"), ("error", "SOX")], "event_type string, regimes string")
    return G.tag_regimes(t.events, table, "event_type").groupBy("regime").agg(F.count(F.lit(1)).alias("n"))


@query("g13_areas", """
SELECT c_custkey, coalesce(r_name, 'UNMAPPED') AS area FROM {customer_dirty} LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
""")
def areas(t: Tables) -> DataFrame:
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return G.map_area(t.customer_dirty, "c_nationkey", nations, "n_nationkey", "r_name").select("c_custkey", "area")


@query("g14_change_log", """
WITH j AS (SELECT o.o_orderkey, o.o_custkey::VARCHAR AS a, d.o_custkey::VARCHAR AS b, o.o_orderstatus AS s, d.o_orderstatus AS e FROM orders o JOIN {orders_dirty} d USING (o_orderkey))
SELECT o_orderkey, 'update' AS change, 'o_custkey' AS field, a AS old_value, b AS new_value, 'loader' AS changed_by, '2024-01-31' AS changed_at FROM j WHERE a <> b
UNION ALL SELECT o_orderkey, 'update', 'o_orderstatus', s, e, 'loader', '2024-01-31' FROM j WHERE s <> e
""")
def change_log(t: Tables) -> DataFrame:
    return G.change_log(t.orders, t.orders_dirty, "o_orderkey", ["o_custkey", "o_orderstatus"], "loader", "2024-01-31")


def laplace(salt: str, scale: float) -> str:
    u = f"((('0x' || substr(md5('42|{salt}|' || l_suppkey || '|' || l_returnflag), 1, 12))::BIGINT + 0.5::DOUBLE) / {float(2**48)}::DOUBLE - 0.5::DOUBLE)"
    return f"(-sign({u}) * {scale}::DOUBLE * ln(1 - 2 * abs({u})))"


@query("g15_noisy_export", f"""
WITH g AS (SELECT l_suppkey, l_returnflag, count(*) AS n, CAST(sum(CAST(least(greatest(l_extendedprice, 0), 100000) AS DECIMAL(28,4))) AS DOUBLE) AS s FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, CAST(round(greatest(n + {laplace('n', 2.0)}, 0)) AS BIGINT) AS noisy_count, round(s + {laplace('s', 200000.0)}, 2) AS noisy_sum FROM g WHERE n >= 10
""")
def noisy(t: Tables) -> DataFrame:
    return G.noisy_aggregate(t.lineitem, ["l_suppkey", "l_returnflag"], "l_extendedprice", 1.0, 100_000.0, 10, 42)


PRIVATE = {"eps": 2.0, "bound": 50_000.0, "min_n": 20, "seed": 42, "max_groups": 2, "max_rows": 2}


def _private_sql() -> str:
    """Every order is a subject: at most two rows in each of at most two (supplier, flag) groups."""
    group, value = "'=' || l_suppkey || '|=' || l_returnflag", "least(greatest(l_extendedprice, 0), 50000)::DECIMAL(28,4)"
    def laplace(salt, scale):
        u = f"((('0x' || substr(md5('42|{salt}|' || g), 1, 12))::BIGINT + 0.5::DOUBLE) / {float(2**48)}::DOUBLE - 0.5::DOUBLE)"
        return f"(-sign({u}) * {scale}::DOUBLE * ln(1 - 2 * abs({u})))"
    return f"""
WITH r AS (SELECT l_orderkey, l_suppkey, l_returnflag, {group} AS g, {value} AS v FROM lineitem),
d AS (SELECT *, md5('42|group|' || l_orderkey || '|' || g) AS gd, md5('42|row|' || l_orderkey || '|' || g || '|' || v::VARCHAR) AS rd FROM r),
k AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY gd) AS gr, row_number() OVER (PARTITION BY l_orderkey, gd ORDER BY rd) AS rr FROM d),
s AS (SELECT l_suppkey, l_returnflag, g, count(*) AS n, sum(v)::DOUBLE AS s FROM k WHERE gr <= 2 AND rr <= 2 GROUP BY ALL)
SELECT l_suppkey, l_returnflag, round(n + {laplace('n', 4.0)})::BIGINT AS noisy_count, round(s + {laplace('s', 200000.0)}, 2) AS noisy_sum FROM s WHERE n + {laplace('n', 4.0)} >= 20"""


@query("g15_private_export", _private_sql())
def private_export(t: Tables) -> DataFrame:
    return G.private_export(t.lineitem, "l_orderkey", ["l_suppkey", "l_returnflag"], "l_extendedprice", **PRIVATE)


@query("d2_resource_documents", """
SELECT 'c' || c_custkey AS id, '{"resourceType":"Organization","name":"' || c_name || '","address":[{"nation":"' || n_name || '","region":"' || r_name || '"}]}' AS document
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
""")
def documents(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    keyed = joined.withColumn("key", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    return model.to_resource(keyed, "Organization", "key", {
        "name": F.col("c_name"), "address": F.array(F.struct(F.col("n_name").alias("nation"), F.col("r_name").alias("region")))})


# Long chains: every order leads to the next one of its customer's block of 100.
@query("g3_impact_of_chains", """
WITH RECURSIVE e AS (SELECT o_orderkey AS src, o_orderkey + 1 AS dst FROM orders WHERE o_orderkey % 100 <> 99 UNION ALL SELECT o_orderkey, o_orderkey + 50 FROM orders WHERE o_orderkey % 1000 = 0),
r AS (SELECT o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderkey % 400 = 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node)
SELECT node, min(depth) AS depth FROM r GROUP BY 1
""")
def impact_of_chains(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    links = t.orders.where(key % 100 != 99).select(key.alias("src"), (key + 1).alias("dst")).unionByName(
        t.orders.where(key % 1000 == 0).select(key.alias("src"), (key + 50).alias("dst")))
    return graph.impact(links, t.orders.where(key % 400 == 0).select(key.alias("node")))
