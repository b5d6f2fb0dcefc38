"""Scans, sources, sinks."""

from pyspark.sql import DataFrame, functions as F

from assay.checks.registry import Tables, query
from assay.operators import profile
from assay.sources import layers, readers

ALL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
       "embeddings", "pages", "benchmark", "labels", "conversations")


@query("a1_b1_table_counts", " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ALL]
    + ["SELECT 'TOTAL', " + " + ".join(f"(SELECT count(*) FROM {t})" for t in ALL)]))
def table_counts(t: Tables) -> DataFrame:
    return profile.table_counts({name: getattr(t, name) for name in ALL}, total="TOTAL")


@query("a2_range_extract", """
WITH s AS (SELECT min(o_orderkey) AS lo, ceil((max(o_orderkey) - min(o_orderkey) + 1) / 8.0) AS w FROM orders)
SELECT CAST(least(floor((o_orderkey - lo) / w), 7) AS BIGINT) AS bucket, count(*) AS rows,
       min(o_orderkey) AS min_key, max(o_orderkey) AS max_key
FROM orders, s GROUP BY 1
""")
def range_extract(t: Tables) -> DataFrame:
    return readers.range_summary(t.orders, "o_orderkey", 8)


@query("a3_chunk_plan", """
WITH n AS (SELECT o_custkey, (row_number() OVER (ORDER BY o_custkey) - 1) AS rn FROM orders)
SELECT rn // 8000 AS chunk_id, count(*) AS rows, min(o_custkey) AS min_key, max(o_custkey) AS max_key,
       max(rn) + 1 AS rows_done
FROM n GROUP BY 1
""")
def chunk_plan(t: Tables) -> DataFrame:
    return readers.chunk_plan(t.orders, "o_custkey", 8000)


@query("a4_incremental", """
SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day,
       (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01') AS watermark
FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'
""")
def incremental(t: Tables) -> DataFrame:
    import datetime
    fresh, after = readers.incremental(t.orders, "o_orderdate", datetime.datetime(2000, 1, 1))
    mark = after.select(F.date_format("watermark", "yyyy-MM-dd")).scalar()
    return fresh.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"),
                        mark.alias("watermark"))


@query("a5_bronze_landing", """
SELECT *, '2024-01-31' AS _load_date, '2024-01-31 06:00:00' AS _load_ts, 'erp' AS _source, 'b-1' AS _batch_id
FROM customer
""")
def bronze(t: Tables) -> DataFrame:
    landed = layers.to_bronze(t.customer, "erp", "b-1", "2024-01-31 06:00:00")
    return landed.withColumns({"_load_date": F.col("_load_date").cast("string"),
                               "_load_ts": F.date_format("_load_ts", "yyyy-MM-dd HH:mm:ss")})


@query("a6_dead_letter", """
WITH raw AS (
  SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice < 0 THEN 'minus' ELSE 'ok' END AS price,
         o_orderstatus FROM {orders_dirty})
SELECT o_orderstatus,
       sum(CASE WHEN price = 'ok' THEN 1 ELSE 0 END)::BIGINT AS good,
       sum(CASE WHEN price = 'minus' THEN 1 ELSE 0 END)::BIGINT AS unreadable,
       sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing
FROM raw GROUP BY 1
""")
def dead_letter(t: Tables) -> DataFrame:
    from pyspark.sql.types import StructType
    # negative prices arrive as accounting text, which no decimal cast reads
    raw = t.orders_dirty.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_totalprice") < 0, F.concat(F.lit("("), -F.col("o_totalprice"), F.lit(")")))
        .otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        "o_orderstatus")
    schema = StructType.fromDDL("o_orderkey bigint, o_totalprice decimal(18,2), o_orderstatus string")
    good, rejected = layers.split_dead_letter(raw, schema, required=["o_totalprice"])
    kinds = good.select("o_orderstatus", F.lit("good").alias("kind")).unionByName(rejected.select(
        "o_orderstatus", F.when(F.col("reject_reason").contains("missing"), "missing").otherwise("unreadable").alias("kind")))
    return kinds.groupBy("o_orderstatus").agg(*[
        F.count_if(F.col("kind") == k).alias(k) for k in ("good", "unreadable", "missing")])


@query("a9_monthly_partitions",
       "SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, count(*) AS rows FROM events GROUP BY 1")
def monthly(t: Tables) -> DataFrame:
    return layers.month_counts(t.events, "ts").withColumn("month", F.col("month").cast("string"))


@query("a11_insert_into_target", """
WITH target AS (SELECT DISTINCT l_orderkey, l_linenumber, 0 AS l_partkey FROM lineitem WHERE l_returnflag = 'A'),
fresh AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)
SELECT * FROM target UNION ALL SELECT f.* FROM fresh f ANTI JOIN target t ON t.l_orderkey = f.l_orderkey AND t.l_linenumber = f.l_linenumber
""")
def insert_into_target(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    target = t.lineitem.where("l_returnflag = 'A'").select(*keys).distinct().withColumn("l_partkey", F.lit(0).cast("bigint"))
    return layers.insert_or_ignore(target, t.lineitem.select(*keys, "l_partkey"), keys, ["l_partkey"])


@query("a11_insert_or_ignore", """
SELECT * EXCLUDE (rn) REPLACE (strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax,
                                        l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1
""")
def insert_or_ignore(t: Tables) -> DataFrame:
    kept = layers.insert_or_ignore(None, t.lineitem, ["l_orderkey", "l_linenumber"],
                                   ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax",
                                    "l_returnflag", "l_linestatus"])
    return kept.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


# Text and composite keys, some null; one key holds a tenth of all rows.
KEYED = """
SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'hot' WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority || '/' || (o_custkey % 211) END AS k1,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey % 7 END AS k2 FROM orders
"""


@query("a3_chunk_plan_text_keys", f"""
WITH n AS (SELECT k1, row_number() OVER (ORDER BY k1 NULLS FIRST) - 1 AS rn FROM ({KEYED}) x)
SELECT rn // 700 AS chunk_id, count(*) AS rows, arg_min(coalesce(k1, '-'), rn) AS min_key, arg_max(coalesce(k1, '-'), rn) AS max_key, max(rn) + 1 AS rows_done FROM n GROUP BY 1
""")
def chunk_plan_text(t: Tables) -> DataFrame:
    plan = readers.chunk_plan(t.sql(KEYED, orders=t.orders), "k1", 700)
    return plan.withColumns({c: F.coalesce(c, F.lit("-")) for c in ("min_key", "max_key")})


@query("a3_chunk_plan_composite", f"""
WITH n AS (SELECT coalesce(k2::VARCHAR, '-') || ':' || coalesce(k1, '-') AS k, row_number() OVER (ORDER BY k2 NULLS FIRST, k1 NULLS FIRST) - 1 AS rn FROM ({KEYED}) x)
SELECT rn // 900 AS chunk_id, count(*) AS rows, arg_min(k, rn) AS min_key, arg_max(k, rn) AS max_key, max(rn) + 1 AS rows_done FROM n GROUP BY 1
""")
def chunk_plan_composite(t: Tables) -> DataFrame:
    plan = readers.chunk_plan(t.sql(KEYED, orders=t.orders), ["k2", "k1"], 900)
    shown = lambda c: F.concat_ws(":", F.coalesce(F.col(f"{c}.k2").cast("string"), F.lit("-")), F.coalesce(f"{c}.k1", F.lit("-"))).alias(c)
    return plan.select("chunk_id", "rows", shown("min_key"), shown("max_key"), "rows_done")
