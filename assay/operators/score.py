"""Readiness and compliance scores from measured factors."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assay.operators.ordered import first_rows
from assay.operators.rules import KeyLines

# Weights of the two readiness formulas, in per cent.
CORE_WEIGHTS = {"completeness": 30, "uniqueness": 20, "freshness": 20, "cardinality": 15, "referential": 15}
HEALTH_WEIGHTS = {"phi_completeness": 25, "clinical_code_validity": 25, "temporal_coherence": 20,
                  "referential_integrity": 15, "deid_readiness": 15}
LAYER_ORDER = ["source", "bronze", "silver", "gold", "platinum"]


def readiness(factors: DataFrame, weights: dict[str, int], out: str = "score") -> DataFrame:
    """Weighted sum of factor columns (0..100), truncated. Decimal arithmetic throughout."""
    total = reduce(lambda a, b: a + b, [F.col(c).cast("decimal(9,4)") * F.lit(w) for c, w in weights.items()])
    return factors.withColumn(out, F.floor(total / F.lit(100)).cast("int"))


def readiness_by_table(factors: DataFrame, weights: DataFrame) -> DataFrame:
    """Long form: (table_name, factor, value) with table-specific weights (table_name, factor, weight)."""
    return factors.join(weights, ["table_name", "factor"]).groupBy("table_name").agg(
        F.floor(F.sum(F.col("value").cast("decimal(9,4)") * F.col("weight").cast("decimal(9,4)")) / 100).cast("int").alias("score"))


@dataclass(frozen=True)
class FactorSpec:
    required: list[str]
    keys: list[str]
    freshness: str | None = None
    as_of: str | None = None
    max_age_days: int = 365
    references: list[tuple[str, DataFrame, str]] = field(default_factory=list)


def _percent(num: Column, den: Column) -> Column:
    """Two decimals, truncated, by integer division; 100 when there is nothing to measure."""
    return F.when(den == 0, F.lit(100.0)).otherwise(F.floor(F.lit(10000) * num / den) / 100.0)


def factor_keys(spec: FactorSpec) -> list[list[str]]:
    """The sets of key columns that the factors count."""
    return [spec.keys, *[[fk] for fk, _, _ in spec.references]]


def measure_factors(df: DataFrame, table: str, spec: FactorSpec, lines: KeyLines | None = None) -> DataFrame:
    """The five core factors of one table as percentages.

    completeness: filled cells of the required columns; uniqueness: distinct keys per row; freshness: rows
    not older than the limit; cardinality: columns with more than one value; referential: rows whose
    foreign keys resolve. One pass for the row figures, one for all key figures, which read ``lines`` if they are given.
    """
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(c).alias(f"n{i}") for i, c in enumerate(spec.required)]
    # texts are compared by hash: whether there is a second value needs no order, and numbers aggregate faster
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")}
    probe = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c)) if c in texts else F.col(c)
    aggs += [(F.min(probe(c)) < F.max(probe(c))).alias(f"v{i}") for i, c in enumerate(plain)]
    fresh = F.lit(True)
    if spec.freshness:
        fresh = F.datediff(F.lit(spec.as_of).cast("date"), F.col(spec.freshness).cast("date")) <= spec.max_age_days
    aggs.append(F.count_if(fresh).alias("fresh"))
    lines = lines or KeyLines(df, factor_keys(spec))
    distinct = lines.of(spec.keys).agg(F.count(F.lit(1))).scalar()
    resolved = [
        lines.of([fk]).select(F.col(fk).alias("k"), "n")
        .join(parent.select(F.col(pk).alias("k")).distinct(), "k", "left_semi")
        .agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
        for fk, parent, pk in spec.references
    ]
    base = df.agg(*aggs).withColumn("distinct_keys", distinct)
    for i, r in enumerate(resolved):
        base = base.withColumn(f"r{i}", r)
    rows = F.col("rows")
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    return base.select(
        F.lit(table).alias("table_name"), "rows",
        _percent(add([F.col(f"n{i}") for i in range(len(spec.required))]), rows * len(spec.required)).alias("completeness"),
        _percent(F.col("distinct_keys"), rows).alias("uniqueness"),
        _percent(F.col("fresh"), rows).alias("freshness"),
        _percent(add([F.when(F.col(f"v{i}"), 1).otherwise(0) for i in range(len(plain))]), F.lit(len(plain))).alias("cardinality"),
        (_percent(add([F.col(f"r{i}") for i in range(len(resolved))]), rows * len(resolved)) if resolved else F.lit(100.0)).alias("referential"),
    )


def measure_health_factors(results: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Factors as mean pass rates of the rules that speak for them, one line per table."""
    return results.groupBy("table_name").agg(*[
        F.coalesce(F.avg(F.when(F.col("rule_id").isin(ids), F.col("pass_rate"))), F.lit(100.0)).alias(name)
        for name, ids in groups.items()])


def compliance_score(results: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean pass rate per table and layer; ``weights`` is (rule_id, weight)."""
    by = [c for c in ("table_name", "layer") if c in results.columns]
    return results.join(weights, "rule_id").groupBy(*by).agg(
        F.floor(F.sum(F.col("pass_rate") * F.col("weight")) / F.sum("weight")).cast("int").alias("compliance_score"))


def layer_position(layer: str) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LAYER_ORDER]), F.col(layer))


def regressions(scores: DataFrame) -> DataFrame:
    """Layers whose score lies below the one before (at most five rows per table)."""
    w = W.partitionBy("table_name").orderBy(layer_position("layer"))
    return scores.withColumn("previous", F.lag("score").over(w)).where(F.col("score") < F.col("previous"))


def layer_scores(scores: DataFrame) -> DataFrame:
    """Every layer with the change against the one before."""
    w = W.partitionBy("table_name").orderBy(layer_position("layer"))
    return scores.withColumn("change", F.coalesce(F.col("score") - F.lag("score").over(w), F.lit(0)))


def overall(scores: DataFrame, col: str = "score") -> DataFrame:
    """Truncated mean."""
    return scores.agg(F.floor(F.avg(col)).cast("int").alias("overall"))


def exposure(df: DataFrame, col: str = "compliance_score", limit: int = 50) -> DataFrame:
    return df.withColumn("exposure", F.when(F.col(col) < limit, "exposed").otherwise("protected"))


def top_k(df: DataFrame, part: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    return first_rows(df, part, order, k, rank)


def gaps(scores: DataFrame, target: int, col: str = "compliance_score") -> DataFrame:
    return scores.where(F.col(col) < target).withColumn("gap", F.lit(target) - F.col(col))


def gap_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("gaps"), F.count_distinct("table_name").alias("tables"))


def improvement_paths(results: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Ordered steps of the transitions whose rule is below PASS.

    ``catalogue``: (table_name, transition, step, rule_id, action).
    """
    open_rules = results.where(F.col("status") != "PASS").select("table_name", "rule_id", "pass_rate")
    return catalogue.join(open_rules, ["table_name", "rule_id"])


def expand_catalogue(nested: DataFrame) -> DataFrame:
    """(table_name, transition, steps array<struct<rule_id, action>>) to one row per step."""
    return nested.select("table_name", "transition", F.posexplode("steps").alias("pos", "s")).select(
        "table_name", "transition", (F.col("pos") + 1).alias("step"), "s.rule_id", "s.action")
