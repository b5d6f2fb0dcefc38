"""Discovery: counts, schemas, column profiles, sensitive data, key relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from assay.functions import columns as fx, patterns


def table_counts(tables: dict[str, DataFrame | None], total: str | None = None) -> DataFrame:
    """Rows per table (a missing table counts 0) and, if named, a line with their sum."""
    present = [(n, df) for n, df in tables.items() if df is not None]
    spark = present[0][1].sparkSession
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in present]
    missing = [(n, 0) for n, df in tables.items() if df is None]
    if missing:
        parts.append(spark.createDataFrame(missing, "table_name string, rows long"))
    counts = reduce(DataFrame.unionByName, parts)
    if total is None:
        return counts
    # a grand-total grouping set: every table is counted once
    return counts.rollup("table_name").agg(F.sum("rows").alias("rows")).select(
        F.coalesce("table_name", F.lit(total)).alias("table_name"), "rows")


def schema_profile(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column: table, position, name, type, nullability."""
    rows = [(t, i + 1, f.name, f.dataType.simpleString(), f.nullable)
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")


def _long_form(df: DataFrame, columns: list[str], per_column) -> DataFrame:
    """Turn one row of per-column structs into one row per column."""
    return df.select(F.explode(F.array(*[per_column(c) for c in columns])).alias("p")).select("p.*")


def profile(df: DataFrame, columns: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """Column profile in one aggregate: every figure is mergeable, so one scan and one tiny shuffle.

    Distinct counts are HyperLogLog estimates, p1/p99 come from a bounded sketch; ``profile_exact`` is the
    exact option.
    """
    columns = columns or df.columns
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        aggs += [F.count(c).alias(f"n_{c}"), F.approx_count_distinct(c).alias(f"d_{c}"),
                 F.min(c).cast("string").alias(f"min_{c}"), F.max(c).cast("string").alias(f"max_{c}")]
        if c in numeric:
            aggs += [F.avg(c).alias(f"avg_{c}"), F.stddev(c).alias(f"sd_{c}"),
                     F.percentile_approx(F.col(c).cast("double"), [0.01, 0.99], accuracy).alias(f"p_{c}")]
    none = F.lit(None).cast("double")
    return _long_form(df.agg(*aggs), columns, lambda c: F.struct(
        F.lit(c).alias("column_name"), F.col("rows"),
        (F.lit(100.0) * (F.col("rows") - F.col(f"n_{c}")) / F.greatest("rows", F.lit(1))).alias("null_pct"),
        F.col(f"d_{c}").alias("distinct_count"), F.col(f"min_{c}").alias("min_value"), F.col(f"max_{c}").alias("max_value"),
        (F.col(f"p_{c}")[0] if c in numeric else none).alias("p1"),
        (F.col(f"p_{c}")[1] if c in numeric else none).alias("p99"),
        (F.col(f"avg_{c}") if c in numeric else none).alias("mean"),
        (F.col(f"sd_{c}") if c in numeric else none).alias("stddev"),
    ))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (column, value as text). Map-side aggregation condenses frequent values before the shuffle."""
    melted = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("m"))
    return melted.select("m.*").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_exact(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact rows, nulls, distinct values and most frequent value (ties: smallest text) of each column."""
    return (
        value_counts(df, columns or df.columns)
        .groupBy("column_name")
        .agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count("value").alias("distinct_count"),
            F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("neg"), "value"))).alias("top"),
        )
        .select("column_name", "rows", "nulls", "distinct_count",
                F.col("top.value").alias("top_value"), (-F.col("top.neg")).alias("top_rows"))
    )


def numeric_profile(df: DataFrame, columns: list[str], scale: int | None = None) -> DataFrame:
    """Exact min, max, mean and standard deviation from decimal sums (order of addition cannot matter)."""
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"n_{c}"), F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"),
                 F.sum(fx.exact(df, c, scale)).cast("double").alias(f"s_{c}"), F.sum(fx.exact_square(df, c, scale)).cast("double").alias(f"q_{c}")]
    def line(c):
        n, s, q = F.col(f"n_{c}"), F.col(f"s_{c}"), F.col(f"q_{c}")
        return F.struct(F.lit(c).alias("column_name"), F.col(f"lo_{c}").alias("min_value"), F.col(f"hi_{c}").alias("max_value"),
                        (s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("stddev"))
    return _long_form(df.agg(*aggs), columns, line)


def may_match(col: str, kind: str) -> Column:
    """Cheap necessary condition of a pattern."""
    needle = patterns.NEEDLE.get(kind)
    if needle is None:
        return F.lit(True)
    return F.col(col).contains(needle) if needle else F.col(col).rlike("[0-9]")


def detect_sensitive(df: DataFrame, table: str, rules: dict[str, tuple[str, str]] | None = None,
                     min_rate: float = 0.0, columns: list[str] | None = None) -> DataFrame:
    """Sensitive columns by name and by content, all columns and patterns in one pass.

    ``rules`` maps a kind to (name pattern, value pattern). A column is flagged when its name fits, or
    more than ``min_rate`` of its non-null values contain the value pattern.
    """
    rules = rules or patterns.SENSITIVE
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = [(c, k) for c in columns for k in rules]
    hits = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.count_if(may_match(c, k) & F.col(c).rlike(rules[k][1])).alias(f"h_{c}_{k}") for c, k in cells],
    )
    long = hits.select(F.explode(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.lit(k).alias("kind"),
                 F.lit(c).rlike(rules[k][0]).alias("by_name"), F.col(f"h_{c}_{k}").alias("hits"), F.col(f"n_{c}").alias("values"))
        for c, k in cells])).alias("p")).select("p.*")
    return long.withColumn("flagged", F.col("by_name") | (F.col("hits") > F.col("values") * F.lit(min_rate)))


def identifier_summary(flags: DataFrame, identifier: str = "kind", found: str = "flagged") -> DataFrame:
    """An identifier is present if any table has it; with the number of tables that do."""
    per_table = flags.groupBy(identifier, "table_name").agg(F.bool_or(found).alias("has"))
    return per_table.groupBy(identifier).agg(
        F.bool_or("has").alias("found"), F.count_if("has").alias("tables_with"), F.count(F.lit(1)).alias("tables_checked"))


def identifier_total(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count(F.lit(1)).alias("identifiers"), F.count_if("found").alias("found"))


def sensitive_columns(flags: DataFrame) -> DataFrame:
    """Per table the number of flagged columns and their names (bounded by the width of the table)."""
    return flags.where("flagged").groupBy("table_name").agg(
        F.count_distinct("column_name").alias("n_columns"), F.array_sort(F.collect_set("column_name")).alias("columns"))


def coverage_summary(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Of each required identifier: does a column carry it, and which share of rows is filled."""
    have = {i: c for i, c in mapping.items() if c in df.columns}
    agg = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{k}") for k, c in enumerate(have.values())])
    place = {i: k for k, i in enumerate(have)}
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("identifier"), F.lit(c if i in have else None).cast("string").alias("column_name"),
                 F.lit(i in have).alias("present"),
                 (F.col(f"n_{place[i]}") / F.greatest("rows", F.lit(1)) if i in have else F.lit(0.0)).alias("populated"))
        for i, c in mapping.items()])).alias("p")).select("p.*")


def fk_graph(tables: dict[str, DataFrame], candidates: list[tuple[str, str, str, str]], t: float = 1.0) -> DataFrame:
    """Candidate (child, column, parent, key) edges with the share of distinct child values found in the parent.

    Both sides are reduced to distinct keys before they meet, so the join has no hot key.
    """
    parts = []
    for child, fk, parent, pk in candidates:
        left = tables[child].select(F.col(fk).alias("k")).where("k IS NOT NULL").distinct()
        right = tables[parent].select(F.col(pk).alias("k")).distinct().withColumn("hit", F.lit(1))
        parts.append(left.join(right, "k", "left").agg(
            F.count(F.lit(1)).alias("child_values"), F.count("hit").alias("matched")).select(
            F.lit(child).alias("child"), F.lit(fk).alias("child_column"), F.lit(parent).alias("parent"),
            F.lit(pk).alias("parent_column"), "child_values", "matched"))
    edges = reduce(DataFrame.unionByName, parts)
    return edges.withColumn("is_fk", F.col("matched") >= F.col("child_values") * F.lit(t))


def describe_tables(stats: DataFrame, *meta: DataFrame) -> DataFrame:
    """Stats joined with any number of metadata tables on ``table_name``; a missing entry stays null."""
    return reduce(lambda a, m: a.join(m, "table_name", "left"), meta, stats)


def extract_sensitive(df: DataFrame, key: str, text: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """Values found in free text: one row per (key, kind, value) with its number of occurrences."""
    kinds = kinds or patterns.FREE_TEXT
    found = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.when(may_match(text, k), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).alias("values"))
        for k, p in kinds.items()])).alias("f"))
    return (
        found.select(key, "f.kind", F.explode("f.values").alias("value"))
        .groupBy(key, "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    )
