"""Layers carried forward batch by batch, held against one computation over everything."""

from pyspark.sql import DataFrame, functions as F

from assay.checks.registry import Tables, query
from assay.checks.sinks import place
from assay.operators import rules as R
from assay.plans import increment
from assay.sources import layers

# Three loads: (1) most orders, some with a wrong sign; (2) the others, and corrections; (3) late rows that are older than what stands,
# orders that change their state, and deletions.
LOADS = """
SELECT 1 AS load, 1 AS seq, 'I' AS op, o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 4 <> 3
UNION ALL SELECT 2, 2, 'I', o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 4 = 3
UNION ALL SELECT 2, 2, 'U', o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 70 = 0 THEN NULL ELSE o_totalprice END FROM orders WHERE o_orderkey % 20 = 10
UNION ALL SELECT 3, 0, 'I', o_orderkey, o_custkey, 'L', 1.0 FROM orders WHERE o_orderkey % 25 = 0
UNION ALL SELECT 3, 3, 'U', o_orderkey, o_custkey + 1, 'X', o_totalprice FROM orders WHERE o_orderkey % 30 = 1
UNION ALL SELECT 3, 3, 'D', o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 50 = 7
"""
FINAL = f"""
WITH s AS (SELECT * FROM ({LOADS}) l QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1),
a AS (SELECT *, coalesce(o_totalprice >= 0, false) AS good FROM s WHERE op <> 'D')
"""
COLUMNS = "load int, seq int, op string, o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"


def orders_target(width: int) -> increment.Target:
    return increment.Target(
        "orders", ["o_orderkey"], ["seq"], F.floor(F.col("o_orderkey") / width), rules=[R.Row("price", F.col("o_totalprice") >= 0)],
        deleted=F.col("op") == "D", groups=["o_orderstatus", "o_custkey"], measures={"total": F.col("o_totalprice").cast("decimal(18,2)")})


def loaded(t: Tables) -> tuple[str, increment.Target]:
    """Three loads into Bronze, each carried forward when it has landed."""
    root = place(t, "increment")
    loads = t.sql(LOADS, orders=t.orders)
    target = orders_target(2_000)
    for i in (1, 2, 3):
        landing = layers.to_bronze(loads.where(F.col("load") == i), "erp", f"b{i}", f"2024-01-0{i} 06:00:00")
        layers.write_bronze(landing, root, "orders")
        increment.advance(t.spark, root, target, t.spark.read.parquet(f"{root}/bronze/orders"))
    return root, target


@query("e35_incremental_layers", FINAL + """
SELECT 'silver' AS layer, count(*) AS rows, count(DISTINCT o_orderkey) AS keys, sum(seq)::BIGINT AS seqs FROM s
UNION ALL SELECT 'gold', count(*), count(DISTINCT o_orderkey), sum(seq)::BIGINT FROM a WHERE good
UNION ALL SELECT 'quarantine', count(*), count(DISTINCT o_orderkey), sum(seq)::BIGINT FROM a WHERE NOT good
""")
def incremental_layers(t: Tables) -> DataFrame:
    root, target = loaded(t)
    read = lambda layer: increment.read(t.spark, root, target, layer, COLUMNS)
    out = None
    for layer in ("silver", "gold", "quarantine"):
        line = read(layer).agg(F.lit(layer).alias("layer"), F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("keys"), F.sum("seq").alias("seqs"))
        out = line if out is None else out.unionByName(line)
    return out


@query("e35_incremental_totals", FINAL + """
SELECT o_orderstatus, o_custkey, count(*) AS rows, sum(o_totalprice::DECIMAL(18,2)) AS total FROM a WHERE good GROUP BY ALL
""")
def incremental_totals(t: Tables) -> DataFrame:
    root, target = loaded(t)
    return increment.read(t.spark, root, target, "totals", "o_orderstatus string, o_custkey bigint, rows bigint, total decimal(38,2)")
