"""Column profiles that add up: figures and sketches of each part of a table, stored, and merged into those of any set of parts.

A part (a day, a load) is read once, when it is new. Its line for each column holds exact figures that add (rows, filled, sums, squares, smallest
and largest value) and three mergeable sketches of bounded size: distinct values (HyperLogLog), quantiles (KLL) and frequent values. Merging reads lines,
not rows. One pass over a part makes all of it, the most frequent value included.

Errors of the sketches, whatever the number of parts: the distinct count has a standard error of ``1.04 / sqrt(2^HLL)`` (0.8 %); a quantile's rank
is off by about 0.7 % for KLL_K = 400; every value that fills more than ``1 / (0.75 * TRACKED)`` of the cells is among the
frequent ones. Values longer than ``LONG`` bytes are known by their SHA-256 there. Nested values are compared by their JSON form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from assay.functions import columns as fx
from assay.operators.inclusion import LONG
from assay.sources import layers

HLL, KLL_K, TRACKED, LISTED = 14, 400, 1024, 20
FIGURES = ["rows", "filled", "total", "squares", "lo_number", "hi_number", "lo_text", "hi_text"]


def shown(f: T.StructField) -> Column:
    """A value as text; times so that their order is that of the texts."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c.cast("string")


def short(text: Column) -> Column:
    return F.when(F.octet_length(text) > LONG, F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))).otherwise(text)


def sketch(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def parts_profile(df: DataFrame, part: Column, columns: list[str] | None = None, scale: int | None = None) -> DataFrame:
    """One line per part and column, from one aggregate. ``scale`` is the number of digits after the point that sums of doubles need."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    none = lambda kind: F.lit(None).cast(kind)
    aggs, lines = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(fields):
        c, text = F.col(f"`{f.name}`"), shown(f)
        numeric = isinstance(f.dataType, T.NumericType)
        aggs += [F.count(c).alias(f"n{i}"), sketch("hll_sketch_agg", short(text), F.lit(HLL)).alias(f"d{i}"), sketch("approx_top_k_accumulate", short(text), F.lit(TRACKED)).alias(f"t{i}")]
        if numeric:
            number = c.cast("double")
            aggs += [F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), F.sum(fx.exact(df, f.name, scale)).cast("decimal(38,12)").alias(f"s{i}"),
                     F.sum(fx.exact_square(df, f.name, scale)).cast("decimal(38,8)").alias(f"q{i}"), F.kll_sketch_agg_double(number, F.lit(KLL_K)).alias(f"k{i}")]
        else:
            aggs += [F.min(short(text)).alias(f"lo{i}"), F.max(short(text)).alias(f"hi{i}")]
        pick = lambda kind, test, i=i: F.col(f"{kind}{i}") if test else None
        lines.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col("rows"), F.col(f"n{i}").alias("filled"),
            (F.col(f"s{i}") if numeric else none("decimal(38,12)")).alias("total"), (F.col(f"q{i}") if numeric else none("decimal(38,8)")).alias("squares"),
            (F.col(f"lo{i}") if numeric else none("double")).alias("lo_number"), (F.col(f"hi{i}") if numeric else none("double")).alias("hi_number"),
            (none("string") if numeric else F.col(f"lo{i}")).alias("lo_text"), (none("string") if numeric else F.col(f"hi{i}")).alias("hi_text"),
            F.col(f"d{i}").alias("distinct_sketch"), (F.col(f"k{i}") if numeric else none("binary")).alias("quantile_sketch"), F.col(f"t{i}").alias("top_sketch")))
    wide = df.groupBy(part.cast("string").alias("part")).agg(*aggs)
    return wide.select("part", F.inline(F.array(*lines)))


def merged(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lines of parts added up, per column (and per value of ``by``): again lines that can be merged."""
    return parts.groupBy(*(by or []), "column_name", "data_type").agg(
        *[F.sum(c).alias(c) for c in FIGURES[:4]], F.min("lo_number").alias("lo_number"), F.max("hi_number").alias("hi_number"),
        F.min("lo_text").alias("lo_text"), F.max("hi_text").alias("hi_text"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"), sketch("approx_top_k_combine", F.col("top_sketch"), F.lit(TRACKED)).alias("top_sketch"))


def report(lines: DataFrame, probs: tuple[float, ...] = (0.01, 0.5, 0.99), listed: int = LISTED) -> DataFrame:
    """The profile that lines stand for: shares, distinct count, mean, deviation, quantiles, frequent values with their counts."""
    n, numeric = F.col("filled"), F.col("total").isNotNull() & (F.col("filled") > 0)
    mean = F.col("total").cast("double") / n
    variance = F.greatest(F.col("squares").cast("double") / n - mean * mean, F.lit(0.0))
    keep = [c for c in lines.columns if c not in FIGURES[2:] and not c.endswith("_sketch")]
    return lines.select(
        *keep, (F.lit(100.0) * (F.col("rows") - n) / F.greatest("rows", F.lit(1))).alias("null_pct"), F.hll_sketch_estimate("distinct_sketch").alias("distinct_count"),
        "lo_number", "hi_number", "lo_text", "hi_text", F.when(numeric, mean).alias("mean"), F.when(numeric, F.sqrt(variance)).alias("stddev"),
        F.when(numeric, F.kll_sketch_get_quantile_double("quantile_sketch", F.array(*map(F.lit, probs)))).alias("quantiles"),
        F.filter(sketch("approx_top_k_estimate", F.col("top_sketch"), F.lit(listed)), lambda x: x["item"].isNotNull()).alias("top_values"))


def store_parts(df: DataFrame, root: str, table: str, part: Column, columns: list[str] | None = None, scale: int | None = None) -> int:
    """Profile the parts of the table that are not stored yet and store them; gives their number. A part is never read twice.

    The parts written by one call are one partition of the report, named by a digest of their names, so a call that broke off and is
    repeated overwrites its own output.
    """
    spark = df.sparkSession
    known = stored_parts(spark, root, table)
    name = part.cast("string")
    fresh = [r[0] for r in df.select(name.alias("p")).distinct().collect()] if known is None else [
        r[0] for r in df.select(name.alias("p")).distinct().join(known.select(F.col("part").alias("p")).distinct(), "p", "left_anti").collect()]
    fresh = sorted(p for p in fresh if p is not None)
    if fresh:
        rows = df.where(name.isin(fresh))
        mark = spark.range(1).select(F.md5(F.lit("\n".join(fresh)).cast("binary"))).first()[0]
        layers.write_report(parts_profile(rows, part, columns, scale).withColumnRenamed("part", "of_part"), root, f"profiles-{table}", mark)
    return len(fresh)


def stored_parts(spark: SparkSession, root: str, table: str, wanted: Callable[[Column], Column] | None = None) -> DataFrame | None:
    """Stored lines of a table, of the parts that are wanted; None if there are none."""
    try:
        found = layers.read_report(spark, root, f"profiles-{table}")
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    lines = found.drop("run_id", "part").withColumnRenamed("of_part", "part")
    return lines if wanted is None else lines.where(wanted(F.col("part")))
