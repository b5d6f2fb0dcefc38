"""Inferred keys, mergeable profiles, whole-table forms of discovery."""

from pyspark.sql import DataFrame, functions as F

from assay.checks.registry import CUSTOMER_DIRTY, ORDERS_DIRTY, SCHEMAS, Tables, query
from assay.checks.sinks import place
from assay.operators import inclusion, profile, sketches
from assay.session import cut

KIND = {"int": "i", "bigint": "i", "double": "n", "string": "s", "timestamp_ntz": "t"}
CAST = {"i": "BIGINT", "n": "DOUBLE", "s": "VARCHAR", "t": "TIMESTAMP"}


def columns_of(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in schema.split(", ")]


def pairs_sql(tables: dict[str, str], t: float) -> str:
    """Every pair of comparable columns, brute force; ``tables`` maps names to relations."""
    named = [(name, rel, c, KIND[k]) for name, rel in tables.items() for c, k in columns_of(SCHEMAS[name.removesuffix("_dirty")]) if k in KIND]
    parts = []
    for kind in CAST:
        mine = [(n, r, c) for n, r, c, k in named if k == kind]
        every = " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS tab, '{c}' AS col, CAST({c} AS {CAST[kind]}) AS v FROM {r} AS x WHERE {c} IS NOT NULL" for n, r, c in mine)
        parts.append(f"""SELECT * FROM (WITH v AS MATERIALIZED ({every}), s AS (SELECT tab, col, count(*) AS n FROM v GROUP BY ALL)
  SELECT a.tab AS child, a.col AS child_column, b.tab AS parent, b.col AS parent_column, a.n AS child_values, coalesce(m.n, 0) AS matched, b.n AS parent_values
  FROM s a JOIN s b ON (a.tab, a.col) <> (b.tab, b.col)
  LEFT JOIN (SELECT x.tab AS t1, x.col AS c1, y.tab AS t2, y.col AS c2, count(*) AS n FROM v x JOIN v y USING (v) GROUP BY ALL) m ON t1 = a.tab AND c1 = a.col AND t2 = b.tab AND c2 = b.col)""")
    unique = " UNION ALL ".join(f"SELECT '{n}' AS parent, '{c}' AS parent_column, count(DISTINCT {c}) = count(*) AS parent_unique FROM {r} AS x" for n, r, c, _ in named)
    return f"SELECT p.*, parent_unique FROM ({' UNION ALL '.join(parts)}) p JOIN ({unique}) u USING (parent, parent_column) WHERE matched >= {t}::DOUBLE * child_values"


def edges_sql(found: str) -> str:
    low = lambda c: f"regexp_replace(lower({c}), '^[a-z]{{1,2}}_', '')"
    return f"""WITH f AS MATERIALIZED ({found}), e AS (SELECT * FROM f WHERE parent_unique AND {low('child_column')} = {low('parent_column')})
SELECT e.* FROM e LEFT JOIN e r ON r.child = e.parent AND r.child_column = e.parent_column AND r.parent = e.child AND r.parent_column = e.child_column
WHERE r.child IS NULL OR e.child_values < e.parent_values OR (e.child_values = e.parent_values AND (e.child, e.child_column) >= (e.parent, e.parent_column))"""


ALL = {n: n for n in SCHEMAS}
DIRTY = {"orders_dirty": f"({ORDERS_DIRTY})", "customer_dirty": f"({CUSTOMER_DIRTY})", "lineitem": "lineitem", "nation": "nation"}


def tables_of(t: Tables, names) -> dict[str, DataFrame]:
    return {n: getattr(t, n) for n in names}


@query("b7_inclusions", pairs_sql(ALL, 1.0))
def inclusions(t: Tables) -> DataFrame:
    return inclusion.inclusions(tables_of(t, ALL))


@query("b7_inclusions_partial", pairs_sql(DIRTY, 0.9))
def inclusions_partial(t: Tables) -> DataFrame:
    return inclusion.inclusions(tables_of(t, DIRTY), 0.9)


@query("b7_inferred_keys", edges_sql(pairs_sql(ALL, 1.0)))
def inferred(t: Tables) -> DataFrame:
    return inclusion.inferred_keys(inclusion.inclusions(tables_of(t, ALL)))


def profile_sql(table: str, source: str, scale: int = 2) -> str:
    """Exact figures of every column; what the sketches must hold is TRUE."""
    parts = []
    for c, kind in columns_of(SCHEMAS[table]):
        number = kind in ("int", "bigint", "double")
        lo, hi = (f"min({c})::DOUBLE", f"max({c})::DOUBLE") if number else ("NULL::DOUBLE", "NULL::DOUBLE")
        mean = f"sum({c}::DECIMAL(38,{scale}))::DOUBLE / count({c})" if number else "NULL::DOUBLE"
        parts.append(f"SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS filled, {lo} AS lo_number, {hi} AS hi_number, round({mean}, 6) AS mean, "
                     f"true AS distinct_held, true AS median_held, true AS frequent_held FROM {source} AS x")
    return " UNION ALL ".join(parts)


def held(df: DataFrame, lines: DataFrame) -> DataFrame:
    """The merged profile beside what the rows say: is the distinct count within four standard errors, the median within 1.5 % of its rank, and
    is every value of more than 1/20 of the rows listed, with a count within the stated error?"""
    made = sketches.report(lines).alias("r")
    texts = df.select(*[sketches.short(sketches.shown(f)).alias(f.name) for f in df.schema.fields])
    counts = profile.value_counts(texts, df.columns).where("value IS NOT NULL")
    exact = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("exact_distinct"))
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double")]
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in numbers])).alias("x")).select("x.*").where("v IS NOT NULL")
    median = made.select("column_name", F.col("quantiles")[1].alias("q"))
    ranks = cells.join(F.broadcast(median), "column_name").groupBy("column_name").agg(
        ((F.count_if(F.col("v") < F.col("q")) <= 0.515 * F.count("v")) & (F.count_if(F.col("v") <= F.col("q")) >= 0.485 * F.count("v"))).alias("median_held"))
    listed = made.select("column_name", "rows", F.explode("top_values").alias("t")).select("column_name", F.col("t.item").alias("value"), F.col("t.count").alias("seen"))
    often = counts.join(F.broadcast(made.select("column_name", "rows")), "column_name").where(F.col("n") * sketches.LISTED > F.col("rows"))
    missed = often.join(listed, ["column_name", "value"], "left").groupBy("column_name").agg(
        F.bool_and(F.coalesce(F.abs(F.col("seen") - F.col("n")) * 0.75 * sketches.TRACKED <= F.col("rows"), F.lit(False))).alias("frequent_held"))
    within = F.abs(F.col("distinct_count") - F.coalesce("exact_distinct", F.lit(0))) <= F.greatest(F.lit(2.0), 4 * 1.04 / 2 ** (sketches.HLL / 2) * F.col("exact_distinct"))
    return made.join(exact, "column_name", "left").join(ranks, "column_name", "left").join(missed, "column_name", "left").select(
        "column_name", "rows", "filled", "lo_number", "hi_number", F.round("mean", 6).alias("mean"), F.coalesce(within, F.col("filled") == 0).alias("distinct_held"),
        F.coalesce("median_held", F.lit(True)).alias("median_held"), F.coalesce("frequent_held", F.lit(True)).alias("frequent_held"))


@query("b3_merged_profile_events", profile_sql("events", "events"))
def merged_events(t: Tables) -> DataFrame:
    """Two loads: the days before the 20th, then all of the table, of which only new days are read."""
    root, day = place(t, "profiles"), F.date_format("ts", "yyyy-MM-dd")
    sketches.store_parts(t.events.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")), root, "events", day, scale=2)
    sketches.store_parts(t.events, root, "events", day, scale=2)
    return held(t.events, sketches.merged(sketches.stored_parts(t.spark, root, "events")))


@query("b3_merged_profile_orders", profile_sql("orders", "{orders_dirty}"))
def merged_orders(t: Tables) -> DataFrame:
    """Parts by year, merged to years first and then to the whole: any order of merging gives the same."""
    parts = sketches.parts_profile(t.orders_dirty, F.date_format("o_orderdate", "yyyy-MM"), scale=2)
    years = sketches.merged(cut(parts).withColumn("year", F.substring("part", 1, 4)), ["year"])
    return held(t.orders_dirty, sketches.merged(years))


@query("b3_merged_profile_documents", profile_sql("documents", "documents"))
def merged_documents(t: Tables) -> DataFrame:
    return held(t.documents, sketches.merged(cut(sketches.parts_profile(t.documents, F.col("source")))))
