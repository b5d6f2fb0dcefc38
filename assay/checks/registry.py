"""Queries on the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assay.sources.readers import read_table

# Fixed schemas, so that opening a table starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Defects laid over the clean tables; the text runs unchanged in both engines.
ORDERS_DIRTY = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 33 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey,
       CASE WHEN o_orderkey % 12 = 0 THEN NULL
            WHEN o_orderkey % 20 = 1 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 40 = 7 THEN 'INVALID' ELSE o_orderstatus END AS o_orderstatus,
       o_orderdate, o_orderpriority
FROM orders
"""
CUSTOMER_DIRTY = """
SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_nationkey END AS c_nationkey,
       c_acctbal, c_mktsegment FROM customer
UNION ALL
SELECT c_custkey + 10000000, upper(c_name), c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The test tables of one folder as attributes: ``t.orders``; overlays: ``t.orders_dirty``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name == "orders_dirty":
            return self.sql(ORDERS_DIRTY, orders=self.orders)
        if name == "customer_dirty":
            return self.sql(CUSTOMER_DIRTY, customer=self.customer)
        if name not in SCHEMAS:
            raise AttributeError(name)
        return read_table(self.spark, self.root, name, SCHEMAS[name])

    def sql(self, text: str, **tables: DataFrame) -> DataFrame:
        for name, df in tables.items():
            text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
        return self.spark.sql(text, **tables)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use ``{orders_dirty}`` and ``{customer_dirty}``."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if sql is not None:
            ORACLE[name] = (
                sql.replace("{orders_dirty}", f"({ORDERS_DIRTY})")
                .replace("{customer_dirty}", f"({CUSTOMER_DIRTY})").strip()
            )
        return fn

    return register
