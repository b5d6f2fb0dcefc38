"""What is written to the shared folder and read back: layers, reports, streams, whole runs."""

import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from assay.checks.registry import SCHEMAS, Tables, query
from assay.operators import govern, model, rules as R, score
from assay.plans import medallion
from assay.session import shared_dir
from assay.sources import layers, readers
from assay.streaming import forms


def place(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/check-{name}-{uuid.uuid4().hex}"


@query("a7_layer_writer", """
SELECT o_orderstatus, count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS keys, min(o_orderkey) AS first_key FROM orders GROUP BY 1
""")
def layer_writer(t: Tables) -> DataFrame:
    root = place(t, "layer")
    layers.write_layer(t.orders, root, "silver", "orders", cluster_by=["o_custkey"])
    return readers.read_layer(t.spark, root, "silver", "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_custkey").alias("keys"), F.min("o_orderkey").alias("first_key"))


@query("a12_save_modes", """
SELECT 'overwrite' AS mode, count(*) AS rows FROM customer UNION ALL SELECT 'ignore', count(*) FROM customer
UNION ALL SELECT 'append', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
UNION ALL SELECT 'overwrite again', count(*) FROM supplier
""")
def save_modes(t: Tables) -> DataFrame:
    root, out = place(t, "modes"), []
    customers, suppliers = t.customer.select(F.col("c_custkey").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k"))
    for name, mode, df in (("overwrite", "overwrite", customers), ("ignore", "ignore", suppliers), ("append", "append", suppliers), ("overwrite again", "overwrite", suppliers)):
        layers.write_layer(df, root, "bronze", "t", mode=mode)
        out.append((name, readers.read_layer(t.spark, root, "bronze", "t").count()))
    return t.spark.createDataFrame(out, "mode string, rows bigint")


@query("a10_load_audit", "SELECT 'ann' AS \"user\", 'customer' AS table_name, count(*) AS rows, 'c_name' AS sensitive, 'run-1' AS run_id FROM customer")
def load_audit(t: Tables) -> DataFrame:
    root = place(t, "audit")
    for _ in range(2):  # a repeated load leaves one line
        df, seen = layers.observed(t.customer, f"audit-{uuid.uuid4().hex}")
        layers.write_bronze(layers.to_bronze(df, "erp", "b1", "2024-01-31 06:00:00"), root, "customer", "overwrite")
        layers.write_report(layers.audit_record(t.spark, seen, "ann", "customer", "2024-01-31 06:00:00", ["c_name"]), root, "load_audit", "run-1", "customer")
    return layers.read_report(t.spark, root, "load_audit").select(
        "user", F.col("table").alias("table_name"), "rows", F.array_join("sensitive_columns", ",").alias("sensitive"), "run_id")


@query("a13_metrics", " UNION ALL ".join(f"SELECT '{n}' AS table_name, 'run-1' AS run_id, count(*) AS rows FROM {n}" for n in ("orders", "part", "events")))
def metrics(t: Tables) -> DataFrame:
    root = place(t, "metrics")
    for _ in range(2):
        for n in ("orders", "part", "events"):
            layers.write_report(getattr(t, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows")), root, "metrics", "run-1", n)
    return layers.read_report(t.spark, root, "metrics").select("table_name", "run_id", "rows")


@query("a8_quarantine_sink", """
SELECT 'run-1' AS run_id, o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'null_check:o_totalprice' ELSE 'range:o_totalprice' END AS failed FROM {orders_dirty}
WHERE o_totalprice IS NULL OR o_totalprice < 0
""")
def quarantine_sink(t: Tables) -> DataFrame:
    root = place(t, "quarantine")
    judged = R.judge(t.orders_dirty, [R.null_rule("o_totalprice"), R.Row("range:o_totalprice", F.col("o_totalprice").isNull() | (F.col("o_totalprice") >= 0))])
    for _ in range(2):
        layers.write_quarantine(judged, root, "orders", "run-1")
    return layers.read_quarantine(t.spark, root).select("run_id", "o_orderkey", F.array_join("failed_rules", ",").alias("failed"))


@query("a6_corrupt_records", """
SELECT 'good' AS kind, count(*) AS n FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT 'rejected', count(*) FROM customer WHERE c_custkey % 11 = 0
""")
def corrupt(t: Tables) -> DataFrame:
    path = place(t, "records")
    line = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal"))
    t.customer.select(F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("value")).write.text(path)
    good, bad = layers.read_records(t.spark, path, StructType.fromDDL("c_custkey bigint, c_name string, c_acctbal double"))
    return good.select(F.lit("good").alias("kind")).unionByName(bad.select(F.lit("rejected").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


LAYER_TABLES = ("customer", "orders", "part")


@query("d1_layer_tables", """
SELECT table_name, column_name, column_name IN ('c_name', 'c_acctbal') AS sensitive FROM information_schema.columns WHERE table_name IN ('customer', 'orders', 'part')
""")
def layer_tables(t: Tables) -> DataFrame:
    layer = f"check_{uuid.uuid4().hex}"
    made = model.create_layer_tables(t.spark, {n: getattr(t, n).schema for n in LAYER_TABLES}, layer, sensitive={"customer": ["c_name", "c_acctbal"]})
    rows = [(name.split(".")[1], r["col_name"], r["comment"] == "sensitive") for name in made for r in t.spark.sql(f"DESCRIBE {name}").collect()]
    t.spark.sql(f"DROP DATABASE `{layer}` CASCADE")
    return t.spark.createDataFrame(rows, "table_name string, column_name string, sensitive boolean")


@query("g5_labels", """
SELECT 'c_name' AS column_name, 'PII' AS label, count(c_name) AS filled FROM customer UNION ALL SELECT 'c_name', 'GLBA', count(c_name) FROM customer
UNION ALL SELECT 'c_acctbal', 'GLBA', count(c_acctbal) FROM customer
""")
def labels(t: Tables) -> DataFrame:
    path = place(t, "labels")
    govern.label(t.customer, {"c_name": ["PII", "GLBA"], "c_acctbal": ["GLBA"]}).write.parquet(path)
    back = t.spark.read.parquet(path)
    filled = back.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).isNotNull().alias("x")) for c in back.columns])).alias("s")).groupBy(
        F.col("s.column_name").alias("column_name")).agg(F.count_if("s.x").alias("filled"))
    return govern.labels_of(t.spark, "customer", back).join(filled, "column_name").select("column_name", "label", "filled")


def arrivals(t: Tables, name: str) -> DataFrame:
    """The table as a stream of files: copied to the shared folder first, as arriving files are."""
    path = place(t, f"arrivals-{name}")
    getattr(t, name).write.parquet(path)
    schema = SCHEMAS[name] if name in SCHEMAS else getattr(t, name).schema.simpleString()
    return forms.file_stream(t.spark, path, schema, max_files=4)


@query("i11_arrivals_screened", """
WITH s AS (SELECT c_custkey, c_name AS name, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM customer),
     w AS (SELECT DISTINCT replace(s_name, 'Supplier', 'Customer') AS listed, trim(regexp_replace(lower(replace(s_name, 'Supplier', 'Customer')), '[^a-z0-9]+', ' ', 'g')) AS lk FROM supplier)
SELECT c_custkey, name, listed, levenshtein(k, lk) AS distance FROM s JOIN w ON levenshtein(k, lk) <= 1
""")
def arrivals_screened(t: Tables) -> DataFrame:
    out = place(t, "hits")
    listed = t.supplier.select(F.regexp_replace("s_name", "Supplier", "Customer").alias("listed_name"))
    forms.each_batch(arrivals(t, "customer"), forms.screen_to(out, "c_custkey", "c_name", listed, "listed_name", 1), place(t, "hits-state"))
    return t.spark.read.parquet(f"{out}/batch=*").select("c_custkey", "name", "listed", "distance")


@query("i14_stream_dedupe", "SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    out = place(t, "deduped")
    events = arrivals(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    forms.drain(forms.dedupe_stream(twice, ["event_id"], "ts", "100 days"), out, place(t, "deduped-state"))
    return t.spark.read.parquet(out).select("event_id", "user_id", "event_type")


@query("e35_whole_run_twice", f"""
WITH o AS (SELECT *, o_totalprice IS NOT NULL AS a, coalesce(o_totalprice >= 0, true) AS b, o_custkey IN (SELECT c_custkey FROM customer) AS c FROM {{orders_dirty}}),
l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
k AS (SELECT count(*) AS n FROM {{customer_dirty}}), kb AS (SELECT count(*) AS n FROM {{customer_dirty}} WHERE c_nationkey IS NULL)
SELECT 'orders' AS table_name, count(*) AS silver_rows, count(*) FILTER (a AND b AND c) AS gold_rows, count(*) FILTER (NOT (a AND b AND c)) AS quarantined FROM o
UNION ALL SELECT 'lineitem', count(*), count(*), 0 FROM l UNION ALL SELECT 'customer', k.n, k.n - kb.n, kb.n FROM k, kb
""")
def whole_run(t: Tables) -> DataFrame:
    root = place(t, "run")
    price = R.Row("range:o_totalprice", F.col("o_totalprice").isNull() | (F.col("o_totalprice") >= 0))
    specs = [
        medallion.TableSpec("orders", t.orders_dirty, ["o_orderkey"], ["o_custkey"], lambda s: [R.null_rule("o_totalprice"), price, R.Exists("fk:o_custkey", ["o_custkey"], t.customer, ["c_custkey"])],
                            features=lambda g: g.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))),
        medallion.TableSpec("lineitem", t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"], lambda s: [R.null_rule("l_quantity")]),
        medallion.TableSpec("customer", t.customer_dirty, ["c_custkey"], ["c_name"], lambda s: [R.null_rule("c_nationkey")], sensitive=["c_name"]),
    ]
    for _ in range(2):
        medallion.run(t.spark, root, specs, "run-1", "2024-01-31 06:00:00")
    return layers.read_report(t.spark, root, "metrics").select("table_name", "silver_rows", "gold_rows", "quarantined")


def rate(passed: str) -> str:
    return f"((2000 * ({passed}) + count(*)) // (2 * count(*))) / 10.0::DOUBLE"


RUN_SCORES = f"""
o AS (SELECT *, o_custkey IN (SELECT c_custkey FROM customer) AS c FROM {{orders_dirty}}),
s AS (SELECT CAST(floor(({rate('count(o_totalprice)')} + {rate('count(*) FILTER (coalesce(o_totalprice >= 0, true))')} + {rate('count(*) FILTER (c)')}) / 3) AS INT) AS score FROM o),
f AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS closed FROM o WHERE c AND o_totalprice >= 0 GROUP BY 1),
p AS (SELECT CAST(floor((count(o_custkey) + count(closed)) * 100 / (2 * count(*))) AS INT) AS score FROM f),
l(layer, n, score) AS (SELECT 'source', 1, score FROM s UNION ALL SELECT 'bronze', 2, score FROM s UNION ALL SELECT 'silver', 3, score FROM s UNION ALL SELECT 'gold', 4, 100 UNION ALL SELECT 'platinum', 5, score FROM p)"""


def scored_run(t: Tables) -> str:
    """One run of the orders table through all layers; the folder and the run."""
    root = place(t, "scores")
    price = R.Row("range:o_totalprice", F.col("o_totalprice").isNull() | (F.col("o_totalprice") >= 0))
    closed = F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("closed")
    medallion.run(t.spark, root, [medallion.TableSpec(
        "orders", t.orders_dirty, ["o_orderkey"], ["o_custkey"], lambda s: [R.null_rule("o_totalprice"), price, R.Exists("fk:o_custkey", ["o_custkey"], t.customer, ["c_custkey"])],
        features=lambda g: g.groupBy("o_custkey").agg(closed))], "run-1", "2024-01-31 06:00:00")
    return root


@query("c6_scores_of_five_layers", f"""
WITH {RUN_SCORES} SELECT 'orders' AS table_name, layer, score, coalesce(score - lag(score) OVER (ORDER BY n), 0) AS change FROM l
""")
def five_layers(t: Tables) -> DataFrame:
    return medallion.layer_scores(t.spark, scored_run(t), "run-1")


@query("c6_regressions", f"""
WITH {RUN_SCORES} SELECT * FROM (SELECT 'orders' AS table_name, layer, score, lag(score) OVER (ORDER BY n) AS previous FROM l) WHERE score < previous
""")
def regressions(t: Tables) -> DataFrame:
    return score.regressions(layers.read_report(t.spark, scored_run(t), "layer_scores").select("table_name", "layer", "score"))
