"""Layer tables: landing, rejects, quarantine, clustered writes, audit and metrics."""

from __future__ import annotations

from contextlib import contextmanager
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.types import DataType, StructType

from assay.operators.ordered import first_rows

LAYERS = ("source", "bronze", "silver", "gold", "platinum")


def to_bronze(df: DataFrame, source: str, batch_id: str, load_ts: str) -> DataFrame:
    """Source columns unchanged plus the four landing columns."""
    ts = F.lit(load_ts).cast("timestamp_ntz")
    return df.withColumns({
        "_load_date": ts.cast("date"), "_load_ts": ts, "_source": F.lit(source), "_batch_id": F.lit(batch_id),
    })


def write_bronze(df: DataFrame, root: str, table: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy("_load_date").parquet(f"{root}/bronze/{table}")


def parse_as(name: str, kind: DataType, fmt: str | None = None) -> Column:
    """The column cast to ``kind``; null where the text cannot be read as that type."""
    target = kind.simpleString()
    if target == "date":
        return F.try_to_date(F.col(name), fmt) if fmt else F.col(name).try_cast("date")
    if target in ("timestamp", "timestamp_ntz") and fmt:
        return F.try_to_timestamp(F.col(name), F.lit(fmt)).cast(target)
    return F.col(name).try_cast(target)


def split_dead_letter(df: DataFrame, schema: StructType, formats: dict[str, str] | None = None,
                      required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows in the target types, and rejected source rows with the reason.

    A row is rejected when a value is present but unreadable, or a required value is absent.
    Both outputs come from one projection over the input.
    """
    formats, required = formats or {}, required or []
    typed = {f.name: parse_as(f.name, f.dataType, formats.get(f.name)) for f in schema.fields}
    reasons = [
        F.when(F.col(n).isNotNull() & e.isNull(), F.lit(f"{n}: not a {schema[n].dataType.simpleString()}"))
        for n, e in typed.items()
    ] + [F.when(F.col(n).isNull(), F.lit(f"{n}: missing")) for n in required]
    judged = df.withColumn("reject_reason", F.array_join(F.array_compact(F.array(*reasons)), "; "))
    good = judged.where(F.col("reject_reason") == "").select(*[typed[f.name].alias(f.name) for f in schema.fields])
    return good, judged.where(F.col("reject_reason") != "")


def write_layer(df: DataFrame, root: str, layer: str, table: str, cluster_by: list[str] | None = None,
                mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Write one layer table.

    ``mode="overwrite"`` rebuilds it, ``mode="ignore"`` keeps one that exists. Clustering range-partitions
    and sorts on the given columns, which keeps row-group statistics narrow for later key filters. A hash of
    the row is the last range column, so that a value held by many rows spreads over several files.
    """
    out = df
    if cluster_by:
        out = out.repartitionByRange(*[F.col(c) for c in cluster_by], F.xxhash64(*df.columns)).sortWithinPartitions(*cluster_by)
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{layer}/{table}")


@contextmanager
def file_by_file(spark: SparkSession):
    """Inside, a task scans rows of one file only, so that a table written from a clustered one, row by row, is clustered as that is."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def part_path(root: str, **parts: str) -> str:
    """Folder of one partition, its values escaped as Spark does."""
    return "/".join([root, *[f"{k}={quote(str(v), safe='')}" for k, v in parts.items()]])


def write_quarantine(judged: DataFrame, root: str, table: str, run_id: str) -> None:
    """Rows that failed at least one rule, with the names of the rules, in the partition of the table and the run.

    The partition is overwritten, also by no rows, so a repeated run leaves what it found the last time.
    """
    judged.where(F.size("failed_rules") > 0).write.mode("overwrite").parquet(part_path(f"{root}/quarantine", table=table, run_id=run_id))


def store_judged(judged: DataFrame, root: str, table: str, run_id: str) -> DataFrame:
    """The judged rows as files of the run, read back: what is split from them fits together, and they lie packed by column."""
    path = part_path(f"{root}/judged", table=table, run_id=run_id)
    judged.write.mode("overwrite").parquet(path)
    return judged.sparkSession.read.schema(judged.schema).parquet(path)


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    return _as_text(spark, f"{root}/quarantine", ["table", "run_id"])


def _as_text(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """A partitioned folder whose partition values stay texts, as run numbers may look like numbers or dates."""
    found = spark.read.option("mergeSchema", "true").parquet(path)
    kinds = T.StructType([T.StructField(f.name, T.StringType()) if f.name in parts else f for f in found.schema.fields])
    return spark.read.schema(kinds).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, mode: str = "overwrite") -> None:
    """Table hashed into buckets by its keys: later joins and aggregates on them need no shuffle.

    For keys that are unique or nearly so; a value held by very many rows would fill one bucket.
    """
    df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


def with_month(df: DataFrame, ts: str, out: str = "month") -> DataFrame:
    """Partition column for a ledger: the first day of the month."""
    return df.withColumn(out, F.date_trunc("month", F.col(ts).cast("timestamp")).cast("date"))


def write_monthly(df: DataFrame, root: str, layer: str, table: str, ts: str, mode: str = "overwrite") -> None:
    """Ledger table partitioned by month. ``rebalance`` splits a month that is too large for one task."""
    out = with_month(df, ts)
    out.hint("rebalance", "month").write.mode(mode).partitionBy("month").parquet(f"{root}/{layer}/{table}")


def month_counts(df: DataFrame, ts: str) -> DataFrame:
    return with_month(df, ts).groupBy("month").agg(F.count(F.lit(1)).alias("rows"))


def insert_or_ignore(target: DataFrame | None, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Target plus the batch rows whose key is new; within the batch the first row per key wins."""
    first = first_rows(batch, keys, order)
    if target is None:
        return first
    fresh = first.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def observed(df: DataFrame, name: str, **extra: Column) -> tuple[DataFrame, Observation]:
    """The same rows, counted while they are written; no second pass over the data.

    To be used right before a write without a shuffle in between: stages that run again count again.
    """
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[e.alias(n) for n, e in extra.items()]), seen


def audit_record(spark: SparkSession, seen: Observation, user: str, table: str, load_ts: str,
                 sensitive: list[str]) -> DataFrame:
    """One audit line of a finished load: who, when, which table, how many rows, which sensitive columns."""
    return spark.createDataFrame(
        [(user, load_ts, table, int(seen.get["rows"]), list(sensitive))],
        "user string, load_ts string, table string, rows long, sensitive_columns array<string>",
    )


def write_report(df: DataFrame, root: str, name: str, run_id: str, part: str = "all") -> None:
    """Report rows (audit lines, rule results, run metrics) of one part of a run, in a table that dashboards read.

    A repeated part overwrites its own rows and nothing else.
    """
    df.drop("run_id", "part").write.mode("overwrite").parquet(part_path(f"{root}/reports/{name}", run_id=run_id, part=part))


def read_report(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _as_text(spark, f"{root}/reports/{name}", ["run_id", "part"])


def read_records(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", **options: str) -> tuple[DataFrame, DataFrame]:
    """(readable records, rejected lines) of CSV or JSON files: a line that does not parse is kept as it is, with its reason.

    A record is a line. It is parsed against the schema with the whole line beside it; nothing is dropped.
    """
    wide = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line", **options}
    parse = {"json": lambda: F.from_json("value", wide, how), "csv": lambda: F.from_csv("value", F.lit(wide.simpleString()[7:-1].replace(":", " ")), how)}[fmt]
    found = spark.read.text(path).withColumn("r", parse())
    good = found.where(F.col("r._line").isNull()).select(*[F.col("r").getField(f.name).alias(f.name) for f in schema.fields])
    bad = found.where(F.col("r._line").isNotNull()).select(F.col("value").alias("line"), F.lit(f"not a {fmt} record of the schema").alias("reject_reason"))
    return good, bad
