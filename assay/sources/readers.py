"""Reading source tables: whole, split on a key range, incremental, and in planned chunks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from assay.operators import ordered
from assay.session import cut


def read_table(spark: SparkSession, root: str, name: str, schema: str | StructType, fmt: str = "parquet",
               **options: str) -> DataFrame:
    """Full scan with an explicit schema (no inference job); column pruning and filters reach the files."""
    suffix = ".parquet" if fmt == "parquet" else f".{fmt}"
    return spark.read.schema(schema).format(fmt).options(**options).load(f"{root}/{name}{suffix}")


def read_layer(spark: SparkSession, root: str, layer: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{layer}/{table}")


def read_jdbc_ranges(spark: SparkSession, url: str, table: str, key: str, lower=None, upper=None, n: int = 8,
                     **options: str) -> DataFrame:
    """Parallel extract of a database table: ``n`` connections, each reading one range of ``key``.

    Without bounds the database is asked for the smallest and largest key first.
    """
    if lower is None or upper is None:
        ends = f"SELECT min({key}) AS lo, max({key}) AS hi FROM {table}"
        row = spark.read.format("jdbc").options(url=url, query=ends, **options).load().first()
        lower, upper = row[0], row[1]
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper),
                 numPartitions=str(n), **options)
        .load()
    )


def range_extract(df: DataFrame, key: str, n: int = 8) -> DataFrame:
    """File form of the ranged extract: ``n`` tasks, each holding one range of ``key``."""
    return df.repartitionByRange(n, key)


def range_bucket(key: str, lower: int, upper: int, n: int = 8) -> Column:
    """Number (0..n-1) of the equal-width key range a row falls into, as a JDBC extract would split it."""
    width = max(1, -(-(upper - lower + 1) // n))
    return F.least(F.floor((F.col(key) - F.lit(lower)) / F.lit(width)), F.lit(n - 1)).cast("int")


def range_summary(df: DataFrame, key: str, n: int = 8) -> DataFrame:
    """Rows and key bounds of each of the ``n`` equal-width ranges between the smallest and largest key."""
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    ends = ends.select(F.struct("lo", F.ceil((F.col("hi") - F.col("lo") + 1) / n).alias("width")).alias("s")).scalar()
    return (
        df.select(F.col(key).alias("k"), ends.alias("s"))
        .groupBy(F.least(F.floor((F.col("k") - F.col("s.lo")) / F.col("s.width")), F.lit(n - 1)).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("min_key"), F.max("k").alias("max_key"))
    )


def _numbered_keys(keys: list[str]) -> list[Column]:
    return [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]


def chunk_plan(df: DataFrame, key: str | list[str], size: int) -> DataFrame:
    """Chunks of ``size`` rows in key order, the last one partial: chunk, rows, key bounds, rows so far.

    The key may be of any type that has an order, or several columns (the bounds are structs then); null comes first and is a key
    like any other. Keys may repeat; rows with equal keys fill chunks in sequence, however many they are. Rows are counted per key; the keys are laid
    out by ranges whose borders Spark samples, and a range's first row number is what the ranges before it hold.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [f"__k{i}" for i in range(len(keys))]
    counts = cut(df.groupBy(*_numbered_keys(keys)).agg(F.count(F.lit(1)).alias("c")))
    parts = math.ceil(counts.count() / ordered.HOT_ROWS)
    bound = F.col("__k0") if len(keys) == 1 else F.struct(*[F.col(o).alias(k) for o, k in zip(order, keys)])
    if parts > 1:
        spans = cut(counts.repartitionByRange(parts, *order).withColumn("span", F.spark_partition_id()))
        along = W.partitionBy(F.lit(0)).orderBy("span").rowsBetween(W.unboundedPreceding, -1)  # one line a range
        offsets = spans.groupBy("span").agg(F.sum("c").alias("n")).select("span", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("offset"))
        placed = spans.withColumn("upto", F.sum("c").over(W.partitionBy("span").orderBy(*order))).join(F.broadcast(offsets), "span")
    else:
        placed = counts.withColumn("upto", F.sum("c").over(W.partitionBy(F.lit(0)).orderBy(*order))).withColumn("offset", F.lit(0).cast("long"))
    runs = placed.select(bound.alias("k"), (F.col("offset") + F.col("upto") - F.col("c")).alias("first"), (F.col("offset") + F.col("upto")).alias("last"))
    # a key whose rows cross a chunk border contributes to every chunk it touches
    touched = runs.withColumn("chunk", F.explode(F.sequence(F.expr(f"first DIV {size}L"), F.expr(f"(last - 1) DIV {size}L"))))
    upper = F.least(F.col("last"), (F.col("chunk") + 1) * size)
    return touched.groupBy(F.col("chunk").alias("chunk_id")).agg(
        F.sum(upper - F.greatest("first", F.col("chunk") * size)).alias("rows"), F.min_by("k", "first").alias("min_key"), F.max_by("k", "first").alias("max_key"),
        F.max(upper).alias("rows_done"))


def sampled_ranges(df: DataFrame, key: str | list[str], n: int) -> DataFrame:
    """``n`` ranges of about as many rows each over keys of any type: range, rows, smallest and largest key. Borders come from a sample that Spark takes.

    Rows with one key are in one range; null comes first.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [f"__k{i}" for i in range(len(keys))]
    ranged = df.select(*_numbered_keys(keys)).repartitionByRange(n, *order).withColumn("range_id", F.spark_partition_id())
    bound = F.struct(*order)
    return ranged.groupBy("range_id").agg(F.count(F.lit(1)).alias("rows"), F.min(bound).alias("lo"), F.max(bound).alias("hi")).select(
        "range_id", "rows", *[F.col(f"{side}.{o}").alias(f"{name}_{k}") for side, name in (("lo", "min"), ("hi", "max")) for o, k in zip(order, keys)])


def estimated_chunks(rows: int, size: int) -> int:
    """Chunk count as a progress display shows it: whole chunks only, at least one."""
    return max(1, rows // size)


def incremental(df: DataFrame, ts_col: str, watermark) -> tuple[DataFrame, DataFrame]:
    """Rows newer than the stored watermark, and the next watermark as a one-row table.

    The filter is a plain comparison on the column, so files and row groups below it are skipped.
    The new watermark stays at the old one when nothing arrived.
    """
    fresh = df if watermark is None else df.where(F.col(ts_col) > F.lit(watermark))
    after = fresh.agg(F.coalesce(F.max(ts_col), F.lit(watermark).cast(df.schema[ts_col].dataType)).alias("watermark"))
    return fresh, after
