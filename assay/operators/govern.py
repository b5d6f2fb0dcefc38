"""Lineage, catalogue, drift, labels, policies, consent, audit, change logs and noisy exports."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from assay.functions import columns as fx
from assay.operators.digests import changed_rows, field_changes, row_changes
from assay.operators.meets import open_at
from assay.operators.ordered import first_rows
from assay.sources.layers import write_report

DEFAULT_STEPS = [("source", "bronze", "parallel extract"), ("bronze", "silver", "cleanse and historise"),
                 ("silver", "gold", "rules and aggregates"), ("gold", "platinum", "features")]


def lineage(tables: DataFrame, steps: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """One edge per table and step; ``tables`` has ``table_name`` and any attributes to carry along."""
    layers = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(t).alias("t")) for a, b, t in steps or DEFAULT_STEPS])
    return tables.select("*", F.posexplode(layers).alias("pos", "s")).select(
        *tables.columns, F.concat_ws("/", "s.a", "table_name").alias("src"), F.concat_ws("/", "s.b", "table_name").alias("dst"),
        F.col("s.t").alias("transform"), (F.col("pos") + 1).alias("step"))


def column_lineage(spark: SparkSession, spec: list[tuple[str, list[str], str]]) -> DataFrame:
    """Edges from declared transforms: (transform, input columns, output column)."""
    rows = [(s, dst, name) for name, sources, dst in spec for s in sources]
    return spark.createDataFrame(rows, "src string, dst string, transform string")


def catalogue(spark: SparkSession, tables: dict[str, DataFrame], layer: str, tags: DataFrame | None = None) -> DataFrame:
    """Asset list: table, layer, columns, rows, and the tags given per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(n).alias("table_name"), F.lit(layer).alias("layer"), F.lit(len(df.columns)).alias("columns"), "rows") for n, df in tables.items()]
    out = reduce(DataFrame.unionByName, parts)
    return out.join(tags, "table_name", "left") if tags is not None else out


def catalogue_totals(assets: DataFrame, edges: DataFrame) -> DataFrame:
    return assets.agg(F.count(F.lit(1)).alias("assets")).select("assets", edges.agg(F.count(F.lit(1))).scalar().alias("edges"))


def label(df: DataFrame, tags: dict[str, list[str]]) -> DataFrame:
    """Sensitivity labels in the column metadata; they survive projections and Parquet files."""
    for c, names in tags.items():
        df = df.withMetadata(c, {**df.schema[c].metadata, "sensitivity": names})
    return df


def labels_of(spark: SparkSession, table: str, df: DataFrame) -> DataFrame:
    rows = [(table, f.name, t) for f in df.schema.fields for t in f.metadata.get("sensitivity", [])]
    return spark.createDataFrame(rows, "table_name string, column_name string, label string")


def schema_rows(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in schema.fields],
                                 "column_name string, data_type string, nullable boolean")


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and retyped columns between two schema tables (column_name, data_type)."""
    o = old.select("column_name", F.col("data_type").alias("old_type"))
    n = new.select("column_name", F.col("data_type").alias("new_type"))
    return o.join(n, "column_name", "full").withColumn(
        "change", F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")).where("change IS NOT NULL")


def role_view(df: DataFrame, policy: dict[str, dict[str, str]], role: str) -> DataFrame:
    """Minimum-necessary view: columns a role's policy names, shown, masked or nulled; all others are absent."""
    show = {"show": lambda c: F.col(c), "mask": lambda c: F.mask(F.col(c).cast("string")).alias(c),
            "null": lambda c: F.lit(None).cast(df.schema[c].dataType).alias(c)}
    return df.select(*[show[how](c) for c, how in policy[role].items()])


def apply_consent(df: DataFrame, consent: DataFrame, key: str, given: Column, keep: bool = False) -> DataFrame:
    """Rows whose subject consents, or all rows with a ``consent`` flag; no entry means no consent."""
    yes = consent.where(given).select(key).distinct()
    if not keep:
        return df.join(yes, key, "left_semi")
    return df.join(yes.withColumn("__yes", F.lit(True)), key, "left").withColumn("consent", F.coalesce("__yes", F.lit(False))).drop("__yes")


def access_report(events: DataFrame, ts: str, user: str, purpose: str, win: str = "1 day") -> DataFrame:
    """Accesses per period and user, and how many state no purpose."""
    return events.groupBy(F.window(ts, win).alias("w"), user).agg(
        F.count(F.lit(1)).alias("accesses"), F.count_if(F.col(purpose).isNull()).alias("without_purpose"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).select(
        F.col("w.start").alias("period"), user, "accesses", "without_purpose", "first_ts", "last_ts")


def consumers_without(consumers: DataFrame, agreements: DataFrame, key: str, on_date: Column) -> DataFrame:
    """Consumers without an agreement valid on the date: agreements open at it are counted along time, not pair by pair."""
    valid = agreements.select(key, F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"))
    asked = consumers.withColumn("__on", on_date)
    return open_at(asked, valid, [key], "__on", "__from", "__to", "__open").where("__open = 0").drop("__on", "__open")


def tag_regimes(df: DataFrame, regimes: DataFrame, key: str, text: str = "regimes", sep: str = "/") -> DataFrame:
    """One line per (row, regime) from a text such as ``BSA / AML / GLBA`` per key."""
    tags = regimes.select(key, F.explode(F.split(text, sep)).alias("regime")).withColumn("regime", F.trim("regime")).where("regime <> ''").distinct()
    return df.join(tags, key)


def map_area(df: DataFrame, key: str, areas: DataFrame, area_key: str, name: str) -> DataFrame:
    """Assessment area by equality on the tract, postal code or nation; unmapped rows are kept."""
    side = areas.select(F.col(area_key).alias("__area"), F.col(name).alias("area"))
    return df.join(side, F.col(key) == F.col("__area"), "left").drop("__area").withColumn("area", F.coalesce("area", F.lit("UNMAPPED")))


def change_log(old: DataFrame, new: DataFrame, key: str | list[str], cols: list[str], who: str, when: str, by_digest: bool = False, **digest) -> DataFrame:
    """One line per changed field of each key, inserts and deletes included; null keys are a key, repeated rows count as often as they stand.

    ``by_digest`` compares digests of key ranges first and then the rows of those that differ (see ``digests.changed_rows``).
    """
    keys = [key] if isinstance(key, str) else key
    changes = changed_rows(old, new, keys, cols, **digest) if by_digest else row_changes(old, new, keys, cols)
    return field_changes(changes, keys, cols).withColumns({"changed_by": F.lit(who), "changed_at": F.lit(when)})


def noisy_aggregate(df: DataFrame, by: list[str], value: str, eps: float, bound: float, min_n: int, seed: int) -> DataFrame:
    """Counts and sums per group with Laplace noise; groups under ``min_n`` rows are left out. Not private: a subject may hold many rows, and
    the limit is tested on the exact count; ``private_export`` bounds both.

    Values are clipped to ``[0, bound]``; half of ``eps`` goes to each figure. The noise depends on the
    seed and the group only, so a rerun or a retried task gives the same export.
    """
    def noise(salt: str, scale: float) -> Column:
        group = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
        u = (fx.digest_number(group, 1, 12) + 0.5) / float(2**48) - 0.5
        return -F.signum(u) * scale * F.log(F.lit(1.0) - 2.0 * F.abs(u))
    clipped = F.least(F.greatest(F.col(value).cast("double"), F.lit(0.0)), F.lit(float(bound)))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.sum(clipped.cast("decimal(28,4)")).cast("double").alias("__s")).where(
        F.col("__n") >= min_n).select(
        *by, F.round(F.greatest(F.col("__n") + noise("n", 2.0 / eps), F.lit(0.0))).cast("long").alias("noisy_count"),
        F.round(F.col("__s") + noise("s", 2.0 * bound / eps), 2).alias("noisy_sum"))


def _noise(group: Column, seed: int, salt: str, scale: float) -> Column:
    """Laplace noise of this scale that depends on the seed and the group only."""
    u = (fx.digest_number(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), group), 1, 12) + 0.5) / float(2**48) - 0.5
    return -F.signum(u) * scale * F.log(F.lit(1.0) - 2.0 * F.abs(u))


def bounded(df: DataFrame, subject: str, by: list[str], value: str, bound: float, max_groups: int, max_rows: int, seed: int) -> DataFrame:
    """Of every subject at most ``max_rows`` rows in each of at most ``max_groups`` groups, values clipped to ``[0, bound]``: ``by, value``.

    Which ones is decided by a seeded digest, not by what they hold. Rows without a subject are nobody's and are left out.
    """
    group = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in by])
    clipped = F.least(F.greatest(F.col(value).cast("double"), F.lit(0.0)), F.lit(float(bound)))
    who = F.col(subject).cast("string")
    rows = df.where(F.col(subject).isNotNull()).select(
        F.col(subject).alias("__who"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], clipped.cast("decimal(28,4)").alias("__v"),
        F.md5(F.concat_ws("|", F.lit(f"{seed}|group"), who, group)).alias("__gd"),
        F.md5(F.concat_ws("|", F.lit(f"{seed}|row"), who, group, F.coalesce(clipped.cast("decimal(28,4)").cast("string"), F.lit("-")))).alias("__rd"))
    few = first_rows(rows, ["__who", "__gd"], ["__rd"], max_rows)
    chosen = few.withColumn("__rank", F.dense_rank().over(W.partitionBy("__who").orderBy("__gd"))).where(F.col("__rank") <= max_groups)
    return chosen.select(*[F.col(f"__g{i}").alias(c) for i, c in enumerate(by)], F.col("__v").alias(value))


def private_export(df: DataFrame, subject: str, by: list[str], value: str, eps: float, bound: float, min_n: float, seed: int,
                   max_groups: int = 1, max_rows: int = 1) -> DataFrame:
    """Noisy counts and sums per group of which no subject changes more than a stated bound.

    One subject moves all counts together by at most ``max_groups * max_rows`` and all sums by that times ``bound``; the noise of either has that over ``eps / 2`` as
    scale. A group is shown if its noisy count reaches ``min_n``, so whether it is shown is as private as the count.
    """
    moved = float(max_groups * max_rows)
    group = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in by])
    kept = bounded(df, subject, by, value, bound, max_groups, max_rows, seed)
    sums = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("__s"))
    count = F.col("__n") + _noise(group, seed, "n", 2.0 * moved / eps)
    return sums.withColumn("__c", count).where(F.col("__c") >= min_n).select(
        *by, F.round("__c").cast("long").alias("noisy_count"), F.round(F.col("__s") + _noise(group, seed, "s", 2.0 * moved * bound / eps), 2).alias("noisy_sum"))


LEDGER = "dataset string, export string, eps double"


def spend(spark: SparkSession, root: str, dataset: str, export: str, eps: float, budget: float) -> float:
    """Enter an export in the dataset's ledger and give what is left of its budget; an export that would overspend is refused.

    An export is entered under its name, so one that is repeated (same seed, same result) does not spend again.
    """
    if not 0 < eps:
        raise ValueError("an export must spend something")
    try:
        spent = {r.export: r.eps for r in spark.read.schema(LEDGER).parquet(f"{root}/reports/privacy_ledger/*/*").where(F.col("dataset") == dataset).collect()}
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        spent = {}
    after = spent | {export: max(eps, spent.get(export, 0.0))}
    if sum(after.values()) > budget + 1e-12:
        raise ValueError(f"{export} would spend {eps} of {budget - sum(spent.values())} left for {dataset}")
    write_report(spark.createDataFrame([(dataset, export, after[export])], LEDGER), root, "privacy_ledger", dataset, export)
    return budget - sum(after.values())
