"""Carry tables from source through Bronze, Silver, Gold and Platinum and report what happened."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assay.operators import clean, events as K, govern, profile, rules as R, score
from assay.operators.monitor import score_alert
from assay.operators.ordered import crowded, scouts
from assay.session import cut
from assay.sources import layers

EVENT_SCHEMA = ("run_id string, seq bigint, ts timestamp, type string, stage int, name string, table string, layer string, "
                "score int, rows_processed bigint, rows_quarantined bigint")


@dataclass(frozen=True)
class TableSpec:
    """What to do with one table. ``rules`` sees the Silver table; ``features`` turns Gold into Platinum."""
    name: str
    source: DataFrame
    keys: list[str]
    order: list[Column | str]
    rules: Callable[[DataFrame], list[R.Rule]]
    steps: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    features: Callable[[DataFrame], DataFrame] | None = None
    sensitive: list[str] = field(default_factory=list)


class Journal:
    """Run events; a few per table and stage. Each stage's events are stored when it begins and when it ends."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root, self.run_id, self.seq, self.stage, self.rows = spark, root, run_id, 0, 0, []

    def add(self, type: str, **values) -> None:
        self.seq += 1
        row = {"run_id": self.run_id, "seq": self.seq, "ts": datetime.now(timezone.utc), "type": type, **values}
        self.rows.append(tuple(row.get(f.split()[0]) for f in EVENT_SCHEMA.split(", ")))

    def store(self) -> None:
        layers.write_report(self.spark.createDataFrame(self.rows, EVENT_SCHEMA), self.root, "run_events", self.run_id, f"stage-{self.stage}")

    @contextmanager
    def during(self, stage: int, name: str):
        """A stage of the run. If it fails, its start stays stored and no later stage begins."""
        self.stage, self.rows = stage, []
        self.add("stage_start", stage=stage, name=name)
        self.store()
        yield
        self.add("stage_complete", stage=stage, name=name)
        if stage == LAST_STAGE:
            self.add("pipeline_complete", name=name)
        self.store()


STAGES = ("Discovery", "Assessment", "Target model", "Extraction", "Transform", "Data Quality", "Governance", "Features", "Monitoring")
LAST_STAGE = len(STAGES)
LINES = "table_name string, layer string, rows bigint, quarantined bigint, score int"


def _layer_score(results: DataFrame) -> tuple[int | None, int]:
    """Truncated mean pass rate of the rules, and the rows they ran over (one line per rule)."""
    line = results.agg(F.floor(F.avg("pass_rate")).cast("int"), F.max("rows")).first()
    return line[0], line[1] or 0


def _filled(df: DataFrame) -> int:
    """Truncated percentage of cells that are not null: the score of a feature table, whose columns no rule names."""
    n = len(df.columns)
    share = sum((F.count(F.col(c)) for c in df.columns), F.lit(0)) * 100 / F.greatest(F.count(F.lit(1)) * n, F.lit(1))
    return df.agg(F.floor(share).cast("int")).first()[0]


def _by_range(df: DataFrame, keys: list[str]) -> bool:
    """Whether rows dealt out by ranges of the keys lie together for Spark; floating keys, which it normalises first, do not."""
    return not any("float" in k or "double" in k for k in (df.schema[c].dataType.simpleString() for c in keys))


def run(spark: SparkSession, root: str, specs: list[TableSpec], run_id: str, load_ts: str, user: str = "loader", alert_below: int = 80) -> DataFrame:
    """Carry every table through the nine stages; returns one line per table.

    Each layer is written and read back, so a lost executor repeats tasks of one step only. Row counts
    are taken from the written files, which repeated tasks cannot inflate. Source and Bronze are scored by the same rules, after the
    row-wise steps that give their columns types. Rules are judged once, over the Silver table; Gold and the
    quarantine are two filters of that stored result. Quarantine counts rows, not failures.

    Silver is dealt out by ranges of its keys once, for the choice of rows and for its files, unless a key holds too many rows. Where all rules
    look at single rows, Gold is filtered file by file and keeps the order of Silver.

    A run can be repeated under its run id, also after it broke off: every output is a partition of the run or a whole layer
    table, and is overwritten. Events are stored stage by stage, so a broken run shows how far it came.
    """
    journal = Journal(spark, root, run_id)
    scores: list[tuple] = []
    layer = lambda name, table: spark.read.parquet(f"{root}/{name}/{table}")
    stage = lambda n: journal.during(n, STAGES[n - 1])
    landing = ("_load_date", "_load_ts", "_source", "_batch_id")

    def scored(s: TableSpec, name: str, df: DataFrame, quarantined: int = 0) -> None:
        value, rows = _layer_score(R.run_rules(df, s.name, s.rules(df)))
        scores.append((s.name, name, rows, quarantined, value))
        journal.add("table_update", table=s.name, layer=name, score=value, rows_processed=rows, rows_quarantined=quarantined)

    with stage(1):
        found = profile.schema_profile(spark, {s.name: s.source for s in specs})
        layers.write_report(found, root, "schemas", run_id)
    with stage(2):
        for s in specs:
            scored(s, "source", clean.transform_chain(s.source, s.steps))
    with stage(3):
        planned = [(s.name, name, s.keys, s.sensitive) for s in specs for name in layers.LAYERS[1:] if name != "platinum" or s.features]
        layers.write_report(spark.createDataFrame(planned, "table_name string, layer string, keys array<string>, sensitive_columns array<string>"), root, "target_model", run_id)
    with stage(4):
        for s in specs:
            seen_df, seen = layers.observed(layers.to_bronze(s.source, s.name, run_id, load_ts), f"{run_id}-{s.name}-bronze-{uuid.uuid4().hex[:8]}")
            seen_df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_load_date").parquet(f"{root}/bronze/{s.name}")
            layers.write_report(layers.audit_record(spark, seen, user, s.name, load_ts, s.sensitive), root, "load_audit", run_id, s.name)
            scored(s, "bronze", clean.transform_chain(layer("bronze", s.name).drop(*landing), s.steps))
    with stage(5):
        for s in specs:
            bronze = layer("bronze", s.name).drop(*landing)
            rows = clean.transform_chain(bronze, s.steps)
            if _by_range(rows, s.keys) and not crowded(clean.transform_chain(scouts(bronze), s.steps), s.keys):
                kept = clean.dedupe(rows.repartitionByRange(*s.keys), s.keys, s.order)
                layers.write_layer(kept.sortWithinPartitions(*s.keys), root, "silver", s.name)
            else:
                layers.write_layer(clean.dedupe(rows, s.keys, s.order), root, "silver", s.name, cluster_by=s.keys)
            journal.add("table_update", table=s.name, layer="silver", rows_processed=layer("silver", s.name).count(), rows_quarantined=0)
    with stage(6):
        for s in specs:
            silver = layer("silver", s.name)
            table_rules = s.rules(silver)
            lines = R.key_lines(silver, table_rules)
            results = cut(R.run_rules(silver, s.name, table_rules, lines=lines))
            layers.write_report(results.withColumn("layer", F.lit("silver")), root, "dq_results", run_id, s.name)
            value, rows = _layer_score(results)
            scores.append((s.name, "silver", rows, 0, value))
            in_order = all(isinstance(r, R.Row) for r in table_rules)
            with layers.file_by_file(spark) if in_order else nullcontext():
                judged = layers.store_judged(R.judge(silver, table_rules, lines), root, s.name, run_id)
                good = judged.where(F.size("failed_rules") == 0).drop("failed_rules")
                layers.write_layer(good, root, "gold", s.name, cluster_by=None if in_order else s.keys)
            layers.write_quarantine(judged, root, s.name, run_id)
            gold = layer("gold", s.name)
            scored(s, "gold", gold, rows - gold.count())
    with stage(7):
        names = spark.createDataFrame([(s.name, s.sensitive) for s in specs], "table_name string, sensitive_columns array<string>")
        layers.write_report(govern.lineage(names), root, "lineage", run_id)
    with stage(8):
        for s in specs:
            if s.features:
                layers.write_layer(s.features(layer("gold", s.name)), root, "platinum", s.name)
                made = layer("platinum", s.name)
                scores.append((s.name, "platinum", made.count(), 0, _filled(made)))
                journal.add("table_update", table=s.name, layer="platinum", score=scores[-1][-1], rows_processed=scores[-1][2])
    with stage(9):
        lines = spark.createDataFrame(scores, LINES)
        layers.write_report(lines, root, "layer_scores", run_id)
        layers.write_report(score_alert(lines.where("layer = 'gold'"), alert_below), root, "alerts", run_id)
        one = lambda name, col: F.max(F.when(F.col("layer") == name, F.col(col)))
        report = cut(lines.groupBy("table_name").agg(
            one("silver", "rows").alias("silver_rows"), one("gold", "rows").alias("gold_rows"), one("gold", "quarantined").alias("quarantined"),
            one("silver", "score").alias("silver_score"), one("gold", "score").alias("gold_score")))
        layers.write_report(report, root, "metrics", run_id)
    return report


def state(spark: SparkSession, root: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(state of each table, state of the run), folded from the stored events."""
    seen = layers.read_report(spark, root, "run_events").where(F.col("run_id") == run_id)
    return K.fold_tables(seen), K.fold_run(seen, ["run_id"], "seq")


def layer_scores(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Score of every table in each layer of a run, in long form, with the change from layer to layer."""
    return score.layer_scores(layers.read_report(spark, root, "layer_scores").where(F.col("run_id") == run_id).select("table_name", "layer", "score"))
