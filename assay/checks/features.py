"""Feature tables."""

from pyspark.sql import DataFrame, functions as F

from assay.checks.registry import Tables, query
from assay.operators import features as H, features_banking as B, features_clinical as C, graph

D = "CAST({} AS DECIMAL(18,2))".format


def rolling_sql(table: str, key: str, ts: str, col: str) -> str:
    return f"""
WITH d AS (SELECT {key}, date_diff('day', DATE '1970-01-01', {ts}::DATE) AS tick, count(*) AS n, sum({D(col)}) AS amount FROM {table} GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER a AS n7, sum(n) OVER b AS n30, sum(amount) OVER a AS s7, sum(amount) OVER b AS s30 FROM d
      WINDOW a AS (PARTITION BY {key} ORDER BY tick RANGE BETWEEN 6 PRECEDING AND CURRENT ROW),
             b AS (PARTITION BY {key} ORDER BY tick RANGE BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT {key}, strftime(DATE '1970-01-01' + CAST(tick AS INTEGER), '%Y-%m-%d') AS day, n, CAST(n7 AS BIGINT) AS n_7d, CAST(n30 AS BIGINT) AS n_30d,
       CAST(s30 AS DOUBLE) AS sum_30d, CAST(s7 AS DOUBLE) / n7 AS avg_7d FROM w"""


def rolled(df: DataFrame, key: str, ts: str, col: str) -> DataFrame:
    return H.rolling_features(df, key, ts, col, scale=2).select(
        key, F.col("day").cast("string").alias("day"), "n", "n_7d", "n_30d", F.col("sum_30d").cast("double").alias("sum_30d"), "avg_7d")


@query("h1_rolling_events", rolling_sql("events", "user_id", "ts", "value"))
def rolling_events(t: Tables) -> DataFrame:
    return rolled(t.events, "user_id", "ts", "value")


@query("h1_rolling_orders", rolling_sql("orders", "o_custkey", "o_orderdate", "o_totalprice"))
def rolling_orders(t: Tables) -> DataFrame:
    return rolled(t.orders, "o_custkey", "o_orderdate", "o_totalprice")


@query("h2_lags", """
SELECT event_id, coalesce(lag(value, 1) OVER w, -1) AS lag1, coalesce(lag(value, 2) OVER w, -1) AS lag2, coalesce(value - lag(value) OVER w, 0) AS delta
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def lags(t: Tables) -> DataFrame:
    out = H.lag_features(t.events, "user_id", ["ts", "event_id"], "value", 2)
    return out.select("event_id", F.coalesce("value_lag1", F.lit(-1.0)).alias("lag1"), F.coalesce("value_lag2", F.lit(-1.0)).alias("lag2"),
                      F.coalesce("value_delta", F.lit(0.0)).alias("delta"))


@query("h3_customer_features", f"""
WITH p AS (SELECT o_custkey, count(*) AS f, sum({D('o_totalprice')}) AS v, date_diff('day', max(o_orderdate)::DATE, DATE '2001-08-02') AS r FROM orders GROUP BY 1),
o AS (SELECT v, row_number() OVER (ORDER BY v) AS rn, count(*) OVER () AS n FROM p),
q AS (SELECT max(v) FILTER (rn = ceil(CAST(0.25 AS DOUBLE) * n)) AS a, max(v) FILTER (rn = ceil(CAST(0.5 AS DOUBLE) * n)) AS b, max(v) FILTER (rn = ceil(CAST(0.75 AS DOUBLE) * n)) AS c FROM o)
SELECT c_custkey, coalesce(f, 0) AS frequency, coalesce(CAST(v AS DOUBLE), 0) AS lifetime_value, coalesce(r, -1) AS recency_days,
  coalesce(CAST(v AS DOUBLE) / f, 0) AS monetary, coalesce(round(1 / (1 + exp(-(-3.0::DOUBLE + 0.01::DOUBLE * r))), 8), 0) AS churn_score,
  coalesce(1 + (v > a)::INT + (v > b)::INT + (v > c)::INT, 0) AS segment
FROM customer LEFT JOIN p ON o_custkey = c_custkey, q
""")
def customer(t: Tables) -> DataFrame:
    out = H.customer_features(t.customer, "c_custkey", t.orders, "o_custkey", "o_orderdate", "o_totalprice", "2001-08-02", scale=2)
    return out.select("c_custkey", "frequency", F.coalesce(F.col("lifetime_value").cast("double"), F.lit(0.0)).alias("lifetime_value"),
                      F.coalesce("recency_days", F.lit(-1)).alias("recency_days"), F.coalesce("monetary", F.lit(0.0)).alias("monetary"),
                      F.coalesce(F.round("churn_score", 8), F.lit(0.0)).alias("churn_score"), F.coalesce("segment", F.lit(0)).alias("segment"))


def chunk_sql(table: str, id: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""
WITH w AS (SELECT {id}, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS tk FROM {table}),
c AS (SELECT {id}, tk, unnest(range(0, greatest(CAST(ceil((len(tk) - {overlap}) / {step}.0) AS BIGINT), 1))) AS chunk_no FROM w WHERE len(tk) > 0)
SELECT {id}, chunk_no, len(tk[chunk_no * {step} + 1 : chunk_no * {step} + {size}]) AS n_tokens,
       md5(array_to_string(tk[chunk_no * {step} + 1 : chunk_no * {step} + {size}], ' ')) AS digest FROM c"""


@query("h4_chunks", chunk_sql("documents", "doc_id", 512, 0))
def chunks(t: Tables) -> DataFrame:
    return H.chunk_text(t.documents, "doc_id", "text").select("doc_id", "chunk_no", "n_tokens", F.md5("chunk").alias("digest"))


@query("h4_chunks_overlapping", chunk_sql("documents", "doc_id", 200, 50))
def chunks_overlap(t: Tables) -> DataFrame:
    return H.chunk_text(t.documents, "doc_id", "text", 200, 50).select("doc_id", "chunk_no", "n_tokens", F.md5("chunk").alias("digest"))


@query("h5_hashed_vectors", r"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 128 AS d, sum(CASE WHEN ('0x' || substr(md5(w), 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS v FROM w GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(v * v)::DOUBLE) AS n FROM c GROUP BY 1),
a AS (SELECT doc_id, list(CAST(round(coalesce(v / nullif(n, 0), 0) * 1000000) AS BIGINT) ORDER BY g.d) AS x
      FROM (SELECT doc_id, unnest(range(128)) AS d FROM documents) g LEFT JOIN c USING (doc_id, d) LEFT JOIN n USING (doc_id) GROUP BY 1)
SELECT doc_id, array_to_string(x, ',') AS vector FROM a
""")
def vectors(t: Tables) -> DataFrame:
    millionths = F.transform("vector", lambda x: F.round(x * 1_000_000).cast("bigint").cast("string"))
    return H.hash_embed(t.documents, "doc_id", "text").select("doc_id", F.array_join(millionths, ",").alias("vector"))


@query("h5_centroid_similarity", """
WITH x AS (SELECT vec_id, label, unnest(range(1, 65)) AS pos, embedding FROM embeddings),
c AS (SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS m FROM x GROUP BY 1, 2)
SELECT vec_id, x.label, round(sum(embedding[x.pos]::DOUBLE * m) / sqrt(sum(embedding[x.pos]::DOUBLE * embedding[x.pos]::DOUBLE) * sum(m * m)), 5) AS similarity
FROM x JOIN c ON c.label = x.label AND c.pos = x.pos GROUP BY 1, 2
""")
def similarity(t: Tables) -> DataFrame:
    c = H.centroids(t.embeddings, "label", "embedding")
    return t.embeddings.join(c, "label").select("vec_id", "label", F.round(H.cosine(F.col("embedding"), F.col("centroid")), 5).alias("similarity"))


@query("h6_zscore", f"""
WITH s AS (SELECT CAST(sum({D('c_acctbal')}) AS DOUBLE) / count(*) AS m,
  CAST(sum(CAST(c_acctbal AS DECIMAL(16,2)) * CAST(c_acctbal AS DECIMAL(16,2))) AS DOUBLE) / count(*) AS q FROM customer)
SELECT c_custkey, round((c_acctbal - m) / sqrt(greatest(q - m * m, 0)), 6) AS z FROM customer, s
""")
def zscore(t: Tables) -> DataFrame:
    return H.normalise(t.customer, ["c_acctbal"], scale=2).select("c_custkey", F.round("c_acctbal_norm", 6).alias("z"))


@query("h6_minmax", """
SELECT p_partkey, round((p_size - lo) / (hi - lo), 6) AS size_norm, round((p_retailprice - plo) / (phi - plo), 6) AS price_norm
FROM part, (SELECT CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi, min(p_retailprice) AS plo, max(p_retailprice) AS phi FROM part)
""")
def minmax(t: Tables) -> DataFrame:
    out = H.normalise(t.part, ["p_size", "p_retailprice"], "minmax")
    return out.select("p_partkey", F.round("p_size_norm", 6).alias("size_norm"), F.round("p_retailprice_norm", 6).alias("price_norm"))


PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]


@query("h7_encode", """
SELECT o_orderkey, coalesce(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH'], o_orderpriority), 0) AS code,
  array_to_string(list_transform(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH'], lambda v: (v = o_orderpriority)::INT), '') AS onehot FROM orders
""")
def encoded(t: Tables) -> DataFrame:
    out = H.encode(t.orders, "o_orderpriority", PRIORITIES)
    return out.select("o_orderkey", F.col("o_orderpriority_code").alias("code"),
                      F.array_join(F.col("o_orderpriority_onehot").cast("array<string>"), "").alias("onehot"))


@query("h8_temporal", """
SELECT event_id, hour(ts) AS hour, dayofweek(ts) + 1 AS weekday,
       coalesce(CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT), -1) AS gap FROM events
""")
def temporal(t: Tables) -> DataFrame:
    return H.temporal_features(t.events, "user_id", ["ts", "event_id"]).select(
        "event_id", "hour", "weekday", F.coalesce("gap_seconds", F.lit(-1)).alias("gap"))


@query("h8_bucket_counts", "SELECT user_id, " + ", ".join(f"count(*) FILTER (hour(ts) // 6 = {b}) AS h{b}" for b in range(4)) + " FROM events GROUP BY 1")
def buckets(t: Tables) -> DataFrame:
    bucket = F.concat(F.lit("h"), F.floor(F.hour(F.col("ts")) / 6).cast("string"))
    return H.bucket_counts(t.events, "user_id", bucket, ["h0", "h1", "h2", "h3"])


@query("h10_readmission", """
SELECT o_orderkey, 3 AS los_days, coalesce(date_diff('day', o_orderdate::DATE + 3, (lead(o_orderdate) OVER w)::DATE) BETWEEN 0 AND 30, false) AS readmitted
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def readmission(t: Tables) -> DataFrame:
    stays = t.orders.withColumn("left_on", F.date_add(F.col("o_orderdate").cast("date"), 3))
    return C.encounter_features(stays, "o_orderkey", "o_custkey", "o_orderdate", "left_on").select("o_orderkey", "los_days", "readmitted")


@query("h11_transaction_features", f"""
WITH d AS (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS tick, count(*) AS n, sum({D('value')}) AS amount,
  count(*) FILTER (event_type = 'purchase') AS x, count(*) FILTER (value > 0 AND value % 1 = 0) AS r, count(*) FILTER (value >= 45.0 AND value < 50) AS c FROM events GROUP BY 1, 2),
w AS (SELECT user_id, tick, """ + ", ".join(f"sum({m}) OVER w{k} AS {m}{k}" for k in (1, 7, 30) for m in ("n", "amount", "x", "r", "c")) + " FROM d WINDOW " + ", ".join(
    f"w{k} AS (PARTITION BY user_id ORDER BY tick RANGE BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (1, 7, 30)) + """)
SELECT user_id, strftime(DATE '1970-01-01' + CAST(tick AS INTEGER), '%Y-%m-%d') AS day, """ + ", ".join(
    f"CAST(n{k} AS BIGINT) AS velocity_{k}d, CAST(amount{k} AS DOUBLE) AS sum_{k}d" for k in (1, 7, 30)) + """,
  CAST(x30 AS DOUBLE) / n30 AS cross_border_ratio, CAST(r30 AS DOUBLE) / n30 AS round_ratio, CAST(c30 AS BIGINT) AS structuring_score FROM w
""")
def txn(t: Tables) -> DataFrame:
    out = B.txn_features(t.events, "user_id", "ts", "value", F.col("event_type") == "purchase", 50.0, 0.1, 1, scale=2)
    return out.withColumns({"day": F.col("day").cast("string")} | {f"sum_{k}d": F.col(f"sum_{k}d").cast("double") for k in (1, 7, 30)})


@query("h13_structuring", f"""
WITH d AS (SELECT o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS tick, count(*) AS n, sum({D('o_totalprice')}) AS a
           FROM orders WHERE o_totalprice >= 300000 * (1 - 0.2::DOUBLE) AND o_totalprice < 300000 GROUP BY 1, 2),
w AS (SELECT o_custkey, tick, sum(n) OVER w AS n, sum(a) OVER w AS a FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY tick RANGE BETWEEN 364 PRECEDING AND CURRENT ROW))
SELECT o_custkey, strftime(DATE '1970-01-01' + CAST(tick AS INTEGER), '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n, CAST(a AS DOUBLE) AS amount FROM w WHERE n >= 2
""")
def structuring(t: Tables) -> DataFrame:
    out = B.structuring(t.orders, "o_custkey", "o_orderdate", "o_totalprice", 300000, 0.2, 365, 2, scale=2)
    return out.withColumns({"day": F.col("day").cast("string"), "amount": F.col("amount").cast("double")})


@query("h13_round_share", "SELECT l_partkey, count(*) AS n, count(*) FILTER (l_quantity > 0 AND l_quantity % 10 = 0) AS round_n FROM lineitem GROUP BY 1")
def round_share(t: Tables) -> DataFrame:
    return B.round_share(t.lineitem, "l_partkey", "l_quantity", 10)


@query("h14_account_features", f"""
WITH p AS (SELECT user_id, count(*) AS n, CAST(sum({D('value')}) AS DOUBLE) AS s, CAST(sum(CAST(value AS DECIMAL(16,2)) * CAST(value AS DECIMAL(16,2))) AS DOUBLE) AS q,
  date_diff('day', max(ts)::DATE, DATE '2024-02-15') AS idle_days FROM events GROUP BY 1)
SELECT user_id, n, s / n AS mean, round(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 6) AS volatility, idle_days, idle_days > 16 AS dormant FROM p
""")
def accounts(t: Tables) -> DataFrame:
    return B.account_features(t.events, "user_id", "ts", "value", "2024-02-15", 16, scale=2).withColumn("volatility", F.round("volatility", 6))


@query("h14_usage_features", """
SELECT user_id, count(*) AS uses, count(DISTINCT event_type) AS diversity, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) / count(*) AS remote_ratio FROM events GROUP BY 1
""")
def usage(t: Tables) -> DataFrame:
    return B.usage_features(t.events, "user_id", "event_type", F.col("event_type") == "view")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PARAMS = [(s, lo, hi, pd, lgd) for s in SEGMENTS for lo, hi, pd, lgd in ((-500.0, 0.0, 0.2, 0.9), (0.0, 3000.0, 0.05, 0.45), (3000.0, 100000.0, 0.01, 0.25))]


@query("h15_expected_loss", f"""
WITH params(segment, lo, hi, pd, lgd) AS (VALUES {', '.join(f"('{s}', {lo}::DOUBLE, {hi}::DOUBLE, {pd}, {lgd})" for s, lo, hi, pd, lgd in PARAMS)})
SELECT c_mktsegment, count(*) AS loans, CAST(sum(CAST(pd AS DECIMAL(9,6)) * CAST(lgd AS DECIMAL(9,6)) * greatest({D('c_acctbal')}, 0)) AS DOUBLE) AS reserve, count(*) FILTER (pd IS NULL) AS unrated
FROM customer LEFT JOIN params ON segment = c_mktsegment AND c_acctbal >= lo AND c_acctbal < hi GROUP BY 1
""")
def loss(t: Tables) -> DataFrame:
    params = t.spark.createDataFrame(PARAMS, "c_mktsegment string, lo double, hi double, pd double, lgd double")
    losses = B.expected_loss(t.customer, params, "c_mktsegment", "c_acctbal")
    return B.reserve(losses, ["c_mktsegment"]).withColumn("reserve", F.col("reserve").cast("double"))


TRADE = "SELECT l_partkey AS src, -1 - l_suppkey AS dst FROM lineitem"


def trade(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_partkey").alias("part"), (-1 - F.col("l_suppkey")).alias("supplier"), "l_extendedprice")
    return graph.network(pairs, "part", "supplier", F.col("l_extendedprice").cast("decimal(18,2)"))


@query("h16_network_edges", f"SELECT l_partkey AS src, -1 - l_suppkey AS dst, count(*) AS n, CAST(sum({D('l_extendedprice')}) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2")
def edges(t: Tables) -> DataFrame:
    return trade(t).withColumn("weight", F.col("weight").cast("double"))


@query("h16_degrees", f"""
WITH e AS (SELECT DISTINCT src, dst FROM ({TRADE})), n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e)
SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM n GROUP BY 1
""")
def degree(t: Tables) -> DataFrame:
    return graph.degrees(trade(t))


def component_sql(edges: str) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT src, dst FROM ({edges}) UNION SELECT dst, src FROM ({edges})),
cc(node, component) USING KEY (node) AS (
  SELECT DISTINCT src, src FROM e
  UNION
  SELECT e.dst, min(cc.component) FROM cc JOIN e ON cc.node = e.src JOIN recurring.cc AS r ON r.node = e.dst WHERE cc.component < r.component GROUP BY e.dst)
SELECT node, component FROM cc"""


@query("h16_components_trade", component_sql(TRADE))
def components_trade(t: Tables) -> DataFrame:
    return graph.components(trade(t))


@query("h16_components_orders", component_sql("SELECT -1 - o_orderkey AS src, o_custkey AS dst FROM orders"))
def components_orders(t: Tables) -> DataFrame:
    return graph.components(t.orders.select((-1 - F.col("o_orderkey")).alias("src"), F.col("o_custkey").alias("dst")))


@query("h16_suspicious_clusters", f"""
SELECT min(-1 - o_orderkey) AS component, count(*) + 1 AS nodes, CAST(sum({D('o_totalprice')}) AS DOUBLE) AS weight, count(*) AS transfers,
       count(*) + 1 >= 12 AND sum({D('o_totalprice')}) >= 3000000 AS suspicious FROM orders GROUP BY o_custkey
""")
def suspicious(t: Tables) -> DataFrame:
    pairs = t.orders.select((-1 - F.col("o_orderkey")).alias("a"), F.col("o_custkey").alias("b"), "o_totalprice")
    found = graph.clusters(graph.network(pairs, "a", "b", F.col("o_totalprice").cast("decimal(18,2)")), 12, 3_000_000)
    return found.withColumn("weight", F.col("weight").cast("double"))


@query("h17_days_covered", """
WITH d AS (SELECT DISTINCT o_custkey, unnest(range(0, 46)) + date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day FROM orders)
SELECT o_custkey, count(*) AS days_covered, max(day) - min(day) + 1 AS period_days FROM d GROUP BY 1
""")
def covered(t: Tables) -> DataFrame:
    spans = t.orders.withColumn("until", F.date_add(F.col("o_orderdate").cast("date"), 45))
    return C.covered_days(spans, ["o_custkey"], "o_orderdate", "until", "o_orderkey").select("o_custkey", "days_covered", "period_days")


@query("h18_trend", """
WITH d AS (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS x, count(*) AS n, sum(CAST(round(value * 100) AS HUGEINT)) AS y FROM events GROUP BY 1, 2),
w AS (SELECT user_id, x AS tick, sum(n) OVER w AS n, sum(n * x) OVER w AS sx, sum(y) OVER w AS sy, sum(n * x * x) OVER w AS sxx, sum(y * x) OVER w AS sxy
      FROM d WINDOW w AS (PARTITION BY user_id ORDER BY x RANGE BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT user_id, strftime(DATE '1970-01-01' + CAST(tick AS INTEGER), '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n,
       coalesce(round(CAST(n * sxy - sx * sy AS DOUBLE) / 100 / nullif(CAST(n * sxx - sx * sx AS DOUBLE), 0), 10), 0) AS slope FROM w
""")
def trend(t: Tables) -> DataFrame:
    return C.trend(t.events, ["user_id"], "ts", "value", scale=2).select(
        "user_id", F.col("day").cast("string").alias("day"), "n", F.coalesce(F.round("slope", 10), F.lit(0.0)).alias("slope"))


@query("h18_reference_scores", """
SELECT flag, count(*) AS n, round(CAST(sum(CAST(z AS DECIMAL(18,4))) AS DOUBLE), 4) AS z_sum FROM (
  SELECT round((l_quantity - 25) / 7.5, 4) AS z, CASE WHEN l_quantity > 40 THEN CASE WHEN l_quantity > 48 THEN 'C' ELSE 'H' END
    WHEN l_quantity < 10 THEN CASE WHEN l_quantity > 0 THEN 'L' ELSE 'C' END ELSE 'N' END AS flag FROM lineitem) GROUP BY 1
""")
def reference_scores(t: Tables) -> DataFrame:
    labs = t.lineitem.select(F.col("l_orderkey").alias("patient_id"), F.lit("q").alias("loinc_code"), F.col("l_shipdate").alias("collection_date"),
                             F.col("l_quantity").alias("result_value"), F.lit(10.0).alias("reference_low"), F.lit(40.0).alias("reference_high"),
                             F.lit(48.0).alias("critical_high"))
    return C.lab_features(labs)[0].groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("z_score").cast("decimal(18,4)")).cast("double"), 4).alias("z_sum"))


@query("h19_rates_and_mix", f"""
SELECT c_mktsegment, count(*) AS rows, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS finished,
  CAST(sum({D('o_totalprice')}) AS DOUBLE) / count(*) AS avg_amount,
  CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) / count(*) AS urgent
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1
""")
def rates(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    a = C.rate_features(joined, ["c_mktsegment"], {"finished": F.col("o_orderstatus") == "F"}, "o_totalprice", scale=2)
    b = C.mix(joined, "c_mktsegment", "o_orderpriority", ["1-URGENT"]).withColumnRenamed("share_1-URGENT", "urgent")
    return a.join(b, "c_mktsegment")


@query("h20_risk_vector", """
SELECT event_id, e + l + n AS score, e || ',' || l || ',' || n AS vector, CASE WHEN e + l + n <= 0 THEN 'LOW' WHEN e + l + n <= 50 THEN 'MEDIUM' ELSE 'HIGH' END AS band
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 40 ELSE 0 END AS e, CASE WHEN value > 20 THEN 30 ELSE 0 END AS l, CASE WHEN hour(ts) < 6 THEN 20 ELSE 0 END AS n FROM events)
""")
def risk_vector(t: Tables) -> DataFrame:
    pts = lambda c, p: F.when(c, p).otherwise(0)
    out = H.risk_vector(t.events, {"e": pts(F.col("event_type") == "error", 40), "l": pts(F.col("value") > 20, 30), "n": pts(F.hour(F.col("ts")) < 6, 20)},
                        [(0, "LOW"), (50, "MEDIUM"), (100, "HIGH")])
    return out.select("event_id", "score", F.array_join(F.col("vector").cast("array<int>").cast("array<string>"), ",").alias("vector"), "band")


@query("h21_insured_deposits", f"""
SELECT c_nationkey, c_mktsegment, CAST(d AS DOUBLE) AS deposits, CAST(least(d, 40000) AS DOUBLE) AS insured, CAST(greatest(d - 40000, 0) AS DOUBLE) AS uninsured
FROM (SELECT c_nationkey, c_mktsegment, sum(greatest({D('c_acctbal')}, 0)) AS d FROM customer GROUP BY 1, 2)
""")
def insured(t: Tables) -> DataFrame:
    out = B.insured(t.customer, ["c_nationkey", "c_mktsegment"], "c_acctbal", 40_000)
    return out.withColumns({c: F.col(c).cast("double") for c in ("deposits", "insured", "uninsured")})


@query("h21_concentration", f"""
SELECT c_mktsegment, CAST(s AS DOUBLE) AS amount, round(CAST(s AS DOUBLE) / CAST(total AS DOUBLE), 10) AS share,
  CASE WHEN CAST(s AS DOUBLE) / CAST(total AS DOUBLE) >= 0.21 THEN 'HIGH' WHEN CAST(s AS DOUBLE) / CAST(total AS DOUBLE) >= 0.19 THEN 'MEDIUM' ELSE 'LOW' END AS class
FROM (SELECT c_mktsegment, sum({D('c_acctbal')}) AS s FROM customer GROUP BY 1), (SELECT sum({D('c_acctbal')}) AS total FROM customer)
""")
def concentration(t: Tables) -> DataFrame:
    out = B.concentration(t.customer, ["c_mktsegment"], "c_acctbal")
    return out.withColumn("class", B.capital_class(F.col("share"), [(0.21, "HIGH"), (0.19, "MEDIUM")], "LOW")).withColumns(
        {"amount": F.col("amount").cast("double"), "share": F.round("share", 10)})


@query("h22_alert_bursts", """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS o
           FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, event_type, CAST(session AS BIGINT) AS session, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS merged
FROM s GROUP BY 1, 2, 3
""")
def bursts(t: Tables) -> DataFrame:
    out = H.dedupe_alerts(t.events, ["user_id", "event_type"], ["ts", "event_id"], 6 * 3600)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_ts", "last_ts")})


@query("h22_typologies", """
SELECT event_id, concat_ws(',', CASE WHEN event_type = 'purchase' AND value > 20 THEN 'layering' END, CASE WHEN value BETWEEN 9 AND 10 THEN 'structuring' END) AS typologies FROM events
""")
def typologies(t: Tables) -> DataFrame:
    out = H.tag_typology(t.events, {"layering": (F.col("event_type") == "purchase") & (F.col("value") > 20), "structuring": F.col("value").between(9, 10)})
    return out.select("event_id", F.array_join("typologies", ",").alias("typologies"))
