"""Streaming forms of the monitoring rules. The batch form of each over the same rows gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from assay.operators import matching, monitor
from assay.operators.ordered import first_rows, neighbour
from assay.session import cut


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """New files of a folder; with the checkpoint of the query this is the incremental extract."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available into Parquet, then stop; a restart goes on after the last commit."""
    query = df.writeStream.format("parquet").outputMode(mode).option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def each_batch(df: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = df.writeStream.foreachBatch(action).outputMode(mode).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def access_anomaly(events: DataFrame, ts: str, user: str, subject: str, n: int, win: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """More than ``n`` (estimated) distinct subjects per user and window; a sketch is all the state keeps."""
    return monitor.access_anomaly(events.withWatermark(ts, delay), ts, user, subject, n, win, exact=False)


def rate_alert(events: DataFrame, ts: str, cond: Column, by: list[str], limit: float, win: str, slide: str | None = None,
               delay: str = "10 minutes") -> DataFrame:
    return monitor.rate_alert(events.withWatermark(ts, delay), ts, cond, by, limit, win, slide)


def dedupe_stream(events: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within the delay; later state is discarded."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def alert_sessions(events: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Bursts of alerts per key, emitted when the watermark has passed their end."""
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("merged"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("w")


def monthly_counter(events: DataFrame, key: str, ts: str, n: int, delay: str = "3 days") -> DataFrame:
    """Events per account and month so far, with the freeze flag beyond ``n`` (update mode).

    The counter is a built-in aggregate: a hot account is counted in every task before its partial
    counts meet. Counts are kept per account and day within the state, as the watermark can close only windows of fixed length;
    a day leaves the state when the watermark has passed it. The month's figure is the sum of its days, see ``monthly_total``.
    """
    return events.withWatermark(ts, delay).groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("day_n")).select(
        key, F.col("w.start").cast("date").alias("day"), "day_n")


def monthly_total(days: DataFrame, key: str, n: int) -> DataFrame:
    """Events per account and month, with the freeze flag beyond ``n``, from the latest count of each day."""
    return days.groupBy(key, F.date_trunc("month", F.col("day").cast("timestamp")).alias("month")).agg(
        F.sum("day_n").alias("n")).withColumn("freeze", F.col("n") > n)


def running_balance(events: DataFrame, key: str, signed: Column) -> DataFrame:
    """Balance per account so far (update or complete mode). The state keeps one line per account for ever: a balance never closes."""
    return events.groupBy(key).agg(F.sum(signed).alias("balance"), F.count(F.lit(1)).alias("movements"))


def breaches(events: DataFrame, limits: DataFrame, key: str, value: str, limit: str) -> DataFrame:
    """Stream joined with a static table of limits."""
    return monitor.breaches(events, key, value, limits, limit)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Output of one micro-batch in a folder of its own; a repeated batch overwrites it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def route_to(root: str, conds: dict[str, Column]) -> Callable[[DataFrame, int], None]:
    """Action for ``each_batch``: every queue gets its rows of the batch, which is computed once."""
    def action(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for name, rows in monitor.route(kept, conds).items():
                write_batch(rows, f"{root}/{name}", batch_id)
        finally:
            kept.unpersist()
    return action


def screen_to(path: str, id: str, name: str, watch: DataFrame, watch_name: str, max_dist: int = 1) -> Callable[[DataFrame, int], None]:
    """Action for ``each_batch``: screen arriving names against the list, which is computed once."""
    watch = cut(watch)

    def action(batch: DataFrame, batch_id: int) -> None:
        write_batch(matching.screen(batch, id, name, watch, watch_name, max_dist), path, batch_id)
    return action


def transitions_to(root: str, key: str, order: list[str], status: str, allowed: list[tuple[str, str]]) -> Callable[[DataFrame, int], None]:
    """Action for ``each_batch``: illegal status changes, also across batches.

    The last row of each key is appended to ``root/state``, partitioned by a hash bucket of the key and by batch. A batch
    writes one line per key that it holds and reads, of the buckets that it touches, the lines of earlier batches only, so its cost follows the
    batch and repeating it gives the same output. ``compact_state`` folds old batches from time to time. Rows must not
    arrive later than the batch that holds their successor; rows without status say nothing. Within a batch large keys are split as in
    the batch form.
    """
    def action(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = cut(batch.where(F.col(status).isNotNull()).select(key, *order, status))
        bucketed = new.withColumn("__bucket", bucket_of(key))
        rows = new.withColumn("__new", F.lit(True))
        if batch_id > 0:
            touched = [r[0] for r in bucketed.select("__bucket").distinct().collect()]  # at most STATE_BUCKETS numbers
            schema = T.StructType([*new.schema.fields, T.StructField("__bucket", T.IntegerType()), T.StructField("__batch", T.IntegerType())])
            state = spark.read.schema(schema).parquet(f"{root}/state")
            earlier = state.where(F.col("__bucket").isin(touched) & (F.col("__batch") < batch_id)).join(new.select(key).distinct(), key, "left_semi")
            before = first_rows(earlier, [key], [F.col(c).desc() for c in order]).select(key, *order, status)
            rows = rows.unionByName(before.withColumn("__new", F.lit(False)))
        steps = neighbour(rows, [key], order, {"previous": (status, 1)})
        write_batch(steps.where(F.col("__new") & monitor.illegal(F.col("previous"), F.col(status), allowed)).drop("__new"), f"{root}/illegal", batch_id)
        last = first_rows(bucketed, [key], [F.col(c).desc() for c in order]).withColumn("__batch", F.lit(batch_id))
        last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__batch", "__bucket").parquet(f"{root}/state")
    return action


STATE_BUCKETS = 256


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(STATE_BUCKETS)).cast("int")


def compact_state(spark: SparkSession, root: str, key: str, order: list[str], upto: int) -> None:
    """Fold the state of batches 0 to ``upto`` into batch ``upto``: the last row of each key. The older folders may then be removed.

    To be run between batches, with ``upto`` below the number of the next one.
    """
    state = spark.read.parquet(f"{root}/state").where(F.col("__batch") <= upto)
    last = cut(first_rows(state, [key], [F.col(c).desc() for c in order]).withColumn("__batch", F.lit(upto)))
    last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__batch", "__bucket").parquet(f"{root}/state")
