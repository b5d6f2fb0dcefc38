"""Monitoring rules. Those on windows of time run alike over tables and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assay.functions import columns as fx
from assay.operators.ordered import AUTO, neighbour, position, running


def dq_alerts(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Metrics (subject, metric, value) above their threshold."""
    limits = F.create_map(*[x for m, v in thresholds.items() for x in (F.lit(m), F.lit(float(v)))])
    return metrics.withColumn("threshold", limits[F.col("metric")]).where(F.col("value") > F.col("threshold"))


def access_counts(events: DataFrame, ts: str, user: str, subject: str, win: str, exact: bool = True) -> DataFrame:
    """Distinct subjects per user and tumbling window."""
    count = F.count_distinct(subject) if exact else F.approx_count_distinct(subject, 0.01)
    return events.groupBy(F.window(ts, win).alias("w"), user).agg(count.alias("subjects")).select(
        F.col("w.start").alias("window_start"), user, "subjects")


def access_anomaly(events: DataFrame, ts: str, user: str, subject: str, n: int, win: str = "1 minute", exact: bool = True) -> DataFrame:
    return access_counts(events, ts, user, subject, win, exact).where(F.col("subjects") > n)


def route(df: DataFrame, conds: dict[str, Column]) -> dict[str, DataFrame]:
    """Rows for each named queue; a row may go to several."""
    return {name: df.where(F.coalesce(c, F.lit(False))) for name, c in conds.items()}


def rate_counts(df: DataFrame, ts: str, cond: Column, by: list[str], win: str, slide: str | None = None) -> DataFrame:
    w = F.window(ts, win, slide) if slide else F.window(ts, win)
    return df.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(cond).alias("hits")).select(
        F.col("w.start").alias("window_start"), *by, "rows", "hits", (F.col("hits") / F.col("rows")).alias("rate"))


def rate_alert(df: DataFrame, ts: str, cond: Column, by: list[str], limit: float, win: str, slide: str | None = None) -> DataFrame:
    """Windows in which the share of rows meeting the condition exceeds the limit."""
    return rate_counts(df, ts, cond, by, win, slide).where(F.col("rate") > limit)


def new_codes(current: DataFrame, reference: DataFrame, code: str, ts: str) -> DataFrame:
    """Codes never seen in the reference period, with their first time and number of uses."""
    seen = current.groupBy(code).agg(F.min(ts).alias("first_seen"), F.count(F.lit(1)).alias("uses"))
    return seen.join(reference.select(code).distinct(), code, "left_anti")


def ctr(df: DataFrame, key: str, ts: str, amount: str, limit: float = 10_000, scale: int | None = None) -> DataFrame:
    """Reports due: customers and days with one transaction, or a day's sum, at or above the limit."""
    per = df.groupBy(key, F.col(ts).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(fx.exact(df, amount, scale)).alias("total"), F.max(fx.exact(df, amount, scale)).alias("largest"))
    return per.where((F.col("total") >= limit) | (F.col("largest") >= limit)).withColumn(
        "reason", F.when(F.col("largest") >= limit, "single").otherwise("aggregate"))


def after_hours(df: DataFrame, user: str, ts: str, start: int, end: int, bulk: int) -> DataFrame:
    """Per user and day: accesses outside ``start`` ≤ hour < ``end``, and whether there are more than ``bulk`` in all."""
    outside = ~F.hour(F.col(ts)).between(start, end - 1)
    return df.groupBy(user, F.col(ts).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("outside")).withColumn("bulk", F.col("n") > bulk).where(
        (F.col("outside") > 0) | F.col("bulk"))


def monthly_limit(df: DataFrame, key: str, order: list[str], n: int, hot=AUTO) -> DataFrame:
    """Number each event within its account and month; those beyond ``n`` freeze the account."""
    ts = order[0]
    out = df.withColumn("month", F.date_trunc("month", F.col(ts).cast("timestamp")).cast("date"))
    return position(out, [key, "month"], order, "nth", hot=hot).withColumn("freeze", F.col("nth") > n)


def dq_trend(results: DataFrame, by: list[str], run: str, rate: str = "pass_rate") -> DataFrame:
    """Change of the rate against the run before; one line per rule and run, never row data."""
    w = W.partitionBy(*by).orderBy(run)
    return results.withColumn("previous", F.lag(rate).over(w)).withColumn("change", F.col(rate) - F.col("previous"))


def running_balance(df: DataFrame, key: str, order: list[str], signed: Column, hot=AUTO) -> DataFrame:
    return running(df, [key], order, {"balance": signed}, hot=hot)


def illegal_transitions(df: DataFrame, key: str, order: list[str], status: str, allowed: list[tuple[str, str]], hot=AUTO) -> DataFrame:
    """Status changes that are not among the allowed pairs. A row without status says nothing: it is left out, and the rows around it are neighbours."""
    steps = neighbour(df.where(F.col(status).isNotNull()), [key], order, {"previous": (status, 1)}, hot=hot)
    return steps.where(illegal(F.col("previous"), F.col(status), allowed))


def illegal(before: Column, after: Column, allowed: list[tuple[str, str]]) -> Column:
    """Whether a known status became another one in a way that is not allowed."""
    may = reduce(lambda a, b: a | b, [(before == a) & (after == b) for a, b in allowed], F.lit(False))
    return before.isNotNull() & (before != after) & ~may


def breaches(df: DataFrame, key: str, value: str, limits: DataFrame, limit: str) -> DataFrame:
    """Rows above their entity's limit; the limits are one line per entity."""
    return df.join(limits.select(key, limit), key).where(F.col(value) > F.col(limit))


def score_alert(scores: DataFrame, limit: int = 80) -> DataFrame:
    return scores.groupBy("table_name").agg(F.min("score").alias("score")).where(F.col("score") < limit)
