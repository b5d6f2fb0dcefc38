"""Discovery and profiling."""

from pyspark.sql import DataFrame, functions as F

from assay.checks.registry import Tables, query
from assay.functions import patterns
from assay.operators import profile
from assay.operators.ordered import exact_quantiles


def exact_sql(table: str, columns: list[str], text: dict[str, str] | None = None) -> str:
    def one(c):
        shown = (text or {}).get(c, f"CAST({c} AS VARCHAR)")
        top = f"FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {shown} LIMIT 1"
        return (f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, "
                f"count(DISTINCT {c}) AS distinct_count, (SELECT {shown} {top}) AS top_value, "
                f"(SELECT count(*) {top}) AS top_rows FROM {table}")
    return " UNION ALL ".join(one(c) for c in columns)


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


@query("b3_profile_exact_customer", exact_sql("{customer_dirty}", CUSTOMER))
def profile_customer(t: Tables) -> DataFrame:
    return profile.profile_exact(t.customer_dirty, CUSTOMER)


@query("b3_profile_exact_lineitem", exact_sql("lineitem", LINEITEM))
def profile_lineitem(t: Tables) -> DataFrame:
    return profile.profile_exact(t.lineitem, LINEITEM)


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("b3_profile_numeric", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, min({c}) AS min_value, max({c}) AS max_value,
       round(CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / count({c}), 4) AS mean,
       round(sqrt(greatest(CAST(sum(CAST({c} AS DECIMAL(12,2)) * CAST({c} AS DECIMAL(12,2))) AS DOUBLE) / count({c})
         - (CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / count({c})) * (CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / count({c})), 0)), 3) AS stddev
FROM lineitem""" for c in NUMERIC))
def profile_numeric(t: Tables) -> DataFrame:
    return profile.numeric_profile(t.lineitem, NUMERIC, scale=2).withColumns({"mean": F.round("mean", 4), "stddev": F.round("stddev", 3)})


FINE = "SELECT o_orderkey, o_totalprice / 1e10 AS tiny, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice * 1e-7 END AS small FROM orders"


@query("b3_profile_fine_values", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(1e6 * sum({c}::DECIMAL(38,12))::DOUBLE / count({c}), 6) AS mean_millionths, stddev_pop({c}) > 0 AS varies,
       count({c}) AS filled FROM ({FINE}) GROUP BY ()""" for c in ("tiny", "small")))
def profile_fine(t: Tables) -> DataFrame:
    fine = t.sql(FINE, orders=t.orders)
    found = profile.numeric_profile(fine, ["tiny", "small"], scale=12)
    filled = profile.profile(fine, ["tiny", "small"]).select("column_name", F.round(F.col("rows") * (100 - F.col("null_pct")) / 100).cast("long").alias("filled"))
    return found.join(filled, "column_name").select("column_name", F.round(F.col("mean") * 1e6, 6).alias("mean_millionths"), (F.col("stddev") > 0).alias("varies"), "filled")


QUANTILES = {"p1": 0.01, "p50": 0.5, "p99": 0.99}


@query("b3_exact_quantiles", """
WITH o AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS rn, count(*) OVER () AS n FROM lineitem)
""" + " UNION ALL ".join(
    f"SELECT '{k}' AS name, v AS value FROM o WHERE rn = greatest(ceil(CAST({p} AS DOUBLE) * n), 1)" for k, p in QUANTILES.items()))
def quantiles(t: Tables) -> DataFrame:
    return exact_quantiles(t.lineitem, "l_extendedprice", QUANTILES)


@query("b3_profile_one_pass", """
SELECT 'o_totalprice' AS column_name, count(*) AS rows, 100.0::DOUBLE * (count(*) - count(o_totalprice)) / count(*) AS null_pct,
       min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM {orders_dirty}
UNION ALL
SELECT 'o_custkey', count(*), 100.0::DOUBLE * (count(*) - count(o_custkey)) / count(*), min(o_custkey), max(o_custkey) FROM {orders_dirty}
""")
def profile_one_pass(t: Tables) -> DataFrame:
    p = profile.profile(t.orders_dirty, ["o_totalprice", "o_custkey"])
    return p.select("column_name", "rows", "null_pct", F.col("min_value").cast("double").alias("lo"),
                    F.col("max_value").cast("double").alias("hi"))


TEXTS = {"documents": "text", "pages": "html", "conversations": "text", "customer": "c_name"}


def flags_sql(tables: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{TEXTS[t]}' AS column_name, '{k}' AS kind, "
        f"regexp_matches('{TEXTS[t]}', '{n}') AS by_name, "
        f"count(*) FILTER (regexp_matches({TEXTS[t]}, '{v}')) AS hits, count({TEXTS[t]}) AS values FROM {t}"
        for t in tables for k, (n, v) in patterns.SENSITIVE.items())


def flags(t: Tables, tables: list[str]) -> DataFrame:
    from functools import reduce
    return reduce(DataFrame.unionByName, [
        profile.detect_sensitive(getattr(t, name), name, columns=[TEXTS[name]]) for name in tables])


@query("b4_sensitive_columns",
       f"SELECT *, by_name OR hits > 0 AS flagged FROM ({flags_sql(['documents', 'pages', 'customer'])})")
def sensitive(t: Tables) -> DataFrame:
    return flags(t, ["documents", "pages", "customer"])


@query("b5_identifier_summary", f"""
WITH f AS ({flags_sql(['documents', 'pages', 'conversations'])}),
     p AS (SELECT kind, table_name, bool_or(by_name OR hits > 0) AS has FROM f GROUP BY ALL)
SELECT kind, bool_or(has) AS found, count(*) FILTER (has) AS tables_with, count(*) AS tables_checked FROM p GROUP BY kind
""")
def identifiers(t: Tables) -> DataFrame:
    return profile.identifier_summary(flags(t, ["documents", "pages", "conversations"]))


EDGES = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
         ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
         ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
         ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_orderkey", "customer", "c_custkey")]


@query("b7_fk_graph", " UNION ALL ".join(f"""
SELECT '{c}' AS child, '{f}' AS child_column, '{p}' AS parent, '{k}' AS parent_column,
       (SELECT count(DISTINCT {f}) FROM {c}) AS child_values,
       (SELECT count(DISTINCT {f}) FROM {c} WHERE {f} IN (SELECT {k} FROM {p})) AS matched,
       (SELECT count(*) FROM {c} WHERE {f} NOT IN (SELECT {k} FROM {p})) = 0 AS is_fk""" for c, f, p, k in EDGES))
def fk_graph(t: Tables) -> DataFrame:
    return profile.fk_graph({n: getattr(t, n) for n in {e[0] for e in EDGES} | {e[2] for e in EDGES}}, EDGES)


@query("b8_table_descriptors", """
SELECT n_name AS table_name, r_name AS domain, coalesce(c.rows, 0) AS rows
FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT c_nationkey, count(*) AS rows FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
""")
def descriptors(t: Tables) -> DataFrame:
    named = t.nation.select("n_nationkey", F.col("n_name").alias("table_name"), "n_regionkey")
    counts = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("rows"))
    stats = named.join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        "table_name", F.coalesce("rows", F.lit(0)).alias("rows"))
    meta = named.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("table_name", F.col("r_name").alias("domain"))
    return profile.describe_tables(stats, meta)


@query("b9_sensitive_values", " UNION ALL ".join(f"""
SELECT doc_id, '{k}' AS kind, value, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 0)) AS value FROM documents) GROUP BY ALL""" for k, p in patterns.FREE_TEXT.items()))
def values(t: Tables) -> DataFrame:
    return profile.extract_sensitive(t.documents, "doc_id", "text")
