"""The state of runs and tables, folded from their event messages by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assay.operators.ordered import AUTO, position, running


def fold_latest(events: DataFrame, keys: list[str], attrs: list[str], seq: str) -> DataFrame:
    """Latest non-absent value of every attribute per key; ``max_by`` combines on the map side."""
    return events.groupBy(*keys).agg(*[F.max_by(a, F.when(F.col(a).isNotNull(), F.col(seq))).alias(a) for a in attrs])


def fold_tables(events: DataFrame, seq: str = "seq") -> DataFrame:
    """State of each table from its update messages."""
    attrs = [c for c in ("layer", "score", "rows_processed", "rows_quarantined") if c in events.columns]
    return fold_latest(events.where(F.col("type") == "table_update"), ["table"], attrs, seq)


def fold_whole(events: DataFrame, keys: list[str], value: list[str], seq: str) -> DataFrame:
    """Whole-value replacement: the last message's fields together, absent ones included."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*value), seq).alias("v")).select(*keys, "v.*")


def fold_run(events: DataFrame, keys: list[str], seq: str, type: str = "type", stage: str = "stage",
             start: str = "stage_start", complete: str = "stage_complete", final: str = "pipeline_complete") -> DataFrame:
    """Current stage, number of completed stages, and status per run."""
    is_ = lambda t: F.col(type) == t
    return events.groupBy(*keys).agg(
        F.max_by(stage, F.when(is_(start), F.col(seq))).alias("current_stage"),
        F.count_if(is_(complete)).alias("stages_complete"),
        F.when(F.bool_or(is_(final)), "complete").when(F.bool_or(is_(start)), "running").otherwise("idle").alias("status"))


def completed_stages(events: DataFrame, keys: list[str], order: list[str], type: str = "type", stage: str = "stage",
                     complete: str = "stage_complete", hot=AUTO) -> DataFrame:
    """Completed stages in order, one line each."""
    done = events.where(F.col(type) == complete).select(*keys, *order, *([stage] if stage not in order else []))
    return position(done, keys, order, hot=hot)


def tail(events: DataFrame, order: list[str], n: int = 200) -> DataFrame:
    """The last ``n`` lines in order; every task keeps only its own last ``n``."""
    last = events.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    return last.orderBy(*order)


def run_ids(events: DataFrame, keys: list[str], order: list[str], reset, hot=AUTO) -> DataFrame:
    """Number the segments that reset events open; events before the first belong to run 0."""
    return running(events, keys, order, {"run_id": F.when(reset, 1).otherwise(0)}, hot=hot)


def initial_state(stats: DataFrame) -> DataFrame:
    """State before any event: no layer, no score, all rows, none quarantined."""
    none = lambda t: F.lit(None).cast(t)
    return stats.withColumns({"layer": none("string"), "score": none("int"), "rows_processed": F.col("rows"), "rows_quarantined": F.lit(0)})


def run_summary(events: DataFrame, keys: list[str], ts: str, tables: DataFrame | None = None) -> DataFrame:
    """Duration and number of events per run; with ``tables`` also rows, tables and truncated mean score."""
    span = F.max(F.unix_micros(F.col(ts).cast("timestamp"))) - F.min(F.unix_micros(F.col(ts).cast("timestamp")))
    out = events.groupBy(*keys).agg((span / 1_000_000).alias("duration"), F.count(F.lit(1)).alias("events"))
    if tables is None:
        return out
    sums = tables.groupBy(*keys).agg(F.sum("rows").alias("total_rows"), F.count(F.lit(1)).alias("tables_processed"),
                                     F.floor(F.avg("score")).cast("int").alias("avg_score"))
    return out.join(sums, keys, "left")


def stage_durations(events: DataFrame, keys: list[str], ts: str, type: str = "type", start: str = "stage_start",
                    complete: str = "stage_complete") -> DataFrame:
    """Seconds from the first start to the last completion; null while one of them is missing."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.groupBy(*keys).agg(
        F.round((F.max(F.when(F.col(type) == complete, at)) - F.min(F.when(F.col(type) == start, at))) / 1_000_000, 2).alias("duration"))
