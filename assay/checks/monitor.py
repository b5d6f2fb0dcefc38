"""Monitoring rules and the event fold."""

from pyspark.sql import DataFrame, functions as F

from assay.checks.registry import Tables, query
from assay.operators import events as K, monitor as I

D = "CAST({} AS DECIMAL(18,2))".format
HOUR = "yyyy-MM-dd HH:mm:ss"


@query("i1_dq_alerts", """
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS subject, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*) AS e FROM events GROUP BY 1)
SELECT subject, 'volume' AS metric, CAST(n AS DOUBLE) AS value, 330.0::DOUBLE AS threshold FROM d WHERE n > 330
UNION ALL SELECT subject, 'error_pct', e, 20.0::DOUBLE FROM d WHERE e > 20
""")
def alerts(t: Tables) -> DataFrame:
    days = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("subject")).agg(
        F.count(F.lit(1)).alias("n"), (100.0 * F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("e"))
    metrics = days.select("subject", F.explode(F.array(
        F.struct(F.lit("volume").alias("metric"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("error_pct").alias("metric"), F.col("e").alias("value")))).alias("m")).select("subject", "m.*")
    return I.dq_alerts(metrics, {"volume": 330, "error_pct": 20})


@query("i2_access_anomaly", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(DISTINCT user_id) AS subjects FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id) > 5
""")
def access(t: Tables) -> DataFrame:
    return I.access_anomaly(t.events, "ts", "event_type", "user_id", 5, "1 hour").withColumn("window_start", F.date_format("window_start", HOUR))


@query("i3_i6_routing", """
SELECT 'errors' AS queue, count(*) AS rows FROM events WHERE event_type = 'error'
UNION ALL SELECT 'high_risk', count(*) FROM events WHERE value / 100 > 0.7 UNION ALL SELECT 'review', count(*) FROM events WHERE value > 40 AND event_type = 'purchase'
""")
def routing(t: Tables) -> DataFrame:
    queues = I.route(t.events, {"errors": F.col("event_type") == "error", "high_risk": F.col("value") / 100 > 0.7,
                                "review": (F.col("value") > 40) & (F.col("event_type") == "purchase")})
    from functools import reduce
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(q).alias("queue"), "rows") for q, df in queues.items()])


@query("i4_rate_alert_daily", """
SELECT strftime(ts, '%Y-%m-%d 00:00:00') AS window_start, count(*) AS rows, count(*) FILTER (event_type = 'error') AS hits,
  CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS rate FROM events GROUP BY 1 HAVING CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) > 0.15
""")
def rate_daily(t: Tables) -> DataFrame:
    return I.rate_alert(t.events, "ts", F.col("event_type") == "error", [], 0.15, "1 day").withColumn("window_start", F.date_format("window_start", HOUR))


@query("i4_rate_sliding", """
WITH s AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w, event_type FROM events)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS rows, count(*) FILTER (event_type = 'error') AS hits,
  CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS rate FROM s GROUP BY 1
""")
def rate_sliding(t: Tables) -> DataFrame:
    return I.rate_counts(t.events, "ts", F.col("event_type") == "error", [], "2 days", "1 day").withColumn("window_start", F.date_format("window_start", HOUR))


@query("i5_new_codes", """
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, count(*) AS uses FROM events
WHERE ts >= TIMESTAMP '2024-01-02' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02') GROUP BY 1
""")
def new_codes(t: Tables) -> DataFrame:
    out = I.new_codes(t.events.where("ts >= TIMESTAMP_NTZ '2024-01-02'"), t.events.where("ts < TIMESTAMP_NTZ '2024-01-02'"), "user_id", "ts")
    return out.withColumn("first_seen", F.date_format("first_seen", HOUR))


@query("i7_reports_due", f"""
SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum({D('o_totalprice')}) AS DOUBLE) AS total,
  CAST(max({D('o_totalprice')}) AS DOUBLE) AS largest, CASE WHEN max({D('o_totalprice')}) >= 400000 THEN 'single' ELSE 'aggregate' END AS reason
FROM {{orders_dirty}} GROUP BY 1, 2 HAVING sum({D('o_totalprice')}) >= 400000 OR max({D('o_totalprice')}) >= 400000
""")
def reports(t: Tables) -> DataFrame:
    return I.ctr(t.orders_dirty, "o_custkey", "o_orderdate", "o_totalprice", 400_000, scale=2).withColumns(
        {"day": F.col("day").cast("string"), "total": F.col("total").cast("double"), "largest": F.col("largest").cast("double")})


@query("i8_escalation", """
SELECT o_orderstatus, count(*) AS rows, count(*) FILTER (date_diff('day', o_orderdate::DATE, DATE '2001-08-02') > 25) AS breaches FROM orders GROUP BY 1
""")
def escalation(t: Tables) -> DataFrame:
    from assay.operators import clean
    return clean.sla_breach(t.orders, "o_orderdate", None, 25, "2001-08-02").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("breach").alias("breaches"))


@query("i9_after_hours", """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (hour(ts) < 8 OR hour(ts) >= 18) AS outside, count(*) > 6 AS bulk FROM events
GROUP BY 1, 2 HAVING count(*) FILTER (hour(ts) < 8 OR hour(ts) >= 18) > 0 OR count(*) > 6
""")
def after_hours(t: Tables) -> DataFrame:
    return I.after_hours(t.events, "user_id", "ts", 8, 18, 6).withColumn("day", F.col("day").cast("string"))


@query("i10_monthly_limit", """
SELECT event_id, strftime(ts, '%Y-%m-01') AS month, nth, nth > 6 AS freeze FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) AS nth
  FROM events WHERE event_type = 'purchase')
""")
def monthly_limit(t: Tables) -> DataFrame:
    out = I.monthly_limit(t.events.where("event_type = 'purchase'"), "user_id", ["ts", "event_id"], 6)
    return out.select("event_id", F.col("month").cast("string").alias("month"), "nth", "freeze")


@query("i12_score_alert", """
SELECT table_name, min(score) AS score FROM (SELECT 'e' || event_type AS table_name, CAST(floor(100.0 * count(*) FILTER (value < 30) / count(*)) AS INTEGER) AS score
  FROM events GROUP BY event_type, ts::DATE) GROUP BY 1 HAVING min(score) < 80
""")
def score_alert(t: Tables) -> DataFrame:
    scores = t.events.groupBy("event_type", F.col("ts").cast("date")).agg(
        F.floor(100.0 * F.count_if(F.col("value") < 30) / F.count(F.lit(1))).cast("int").alias("score"))
    return I.score_alert(scores.withColumn("table_name", F.concat(F.lit("e"), "event_type")))


@query("i13_dq_trend", """
WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, ((2000 * count(*) FILTER (value <= 30) + count(*)) // (2 * count(*))) / 10.0::DOUBLE AS pass_rate FROM events GROUP BY 1, 2)
SELECT event_type, day, pass_rate, coalesce(round(pass_rate - lag(pass_rate) OVER (PARTITION BY event_type ORDER BY day), 1), 0) AS change FROM d
""")
def dq_trend(t: Tables) -> DataFrame:
    from assay.operators.rules import pass_rate
    days = t.events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        pass_rate(F.count_if(F.col("value") <= 30), F.count(F.lit(1))).alias("pass_rate"))
    return I.dq_trend(days, ["event_type"], "day").select("event_type", "day", "pass_rate", F.coalesce(F.round("change", 1), F.lit(0.0)).alias("change"))


@query("i15_running_balance", f"""
SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN -{D('value')} ELSE {D('value')} END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS balance FROM events
""")
def balance(t: Tables) -> DataFrame:
    v = F.col("value").cast("decimal(18,2)")
    out = I.running_balance(t.events, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", -v).otherwise(v))
    return out.select("event_id", F.col("balance").cast("double").alias("balance"))


ALLOWED = [("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("signup", "view"), ("error", "view")]


@query("i16_illegal_transitions", f"""
SELECT event_id, p AS previous, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE p IS NOT NULL AND p <> event_type AND (p, event_type) NOT IN ({', '.join(str(a) for a in ALLOWED)})
""")
def transitions(t: Tables) -> DataFrame:
    return I.illegal_transitions(t.events, "user_id", ["ts", "event_id"], "event_type", ALLOWED).select("event_id", "previous", "event_type")


@query("i17_breaches", """
WITH l AS (SELECT l_partkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 1.8::DOUBLE AS lim FROM lineitem GROUP BY 1)
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN l USING (l_partkey) WHERE l_quantity > lim
""")
def breaches(t: Tables) -> DataFrame:
    limits = t.lineitem.groupBy("l_partkey").agg(
        (F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) * 1.8).alias("lim"))
    return I.breaches(t.lineitem, "l_partkey", "l_quantity", limits, "lim").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("k1_fold_latest", """
SELECT user_id, event_type, max_by(value, event_id) FILTER (value > 5) AS value, max_by(props, event_id) AS props FROM events GROUP BY 1, 2
""")
def fold_latest(t: Tables) -> DataFrame:
    absent = t.events.withColumn("value", F.when(F.col("value") > 5, F.col("value")))
    return K.fold_latest(absent, ["user_id", "event_type"], ["value", "props"], "event_id")


@query("k2_fold_run", """
SELECT user_id, max_by(props, event_id) FILTER (event_type = 'view') AS current_stage, count(*) FILTER (event_type = 'purchase') AS stages_complete,
  CASE WHEN bool_or(event_type = 'signup') THEN 'complete' WHEN bool_or(event_type = 'view') THEN 'running' ELSE 'idle' END AS status FROM events GROUP BY 1
""")
def fold_run(t: Tables) -> DataFrame:
    return K.fold_run(t.events, ["user_id"], "event_id", "event_type", "props", "view", "purchase", "signup")


@query("k2_completed_stages", """
SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events WHERE event_type = 'purchase'
""")
def completed(t: Tables) -> DataFrame:
    return K.completed_stages(t.events, ["user_id"], ["event_id"], "event_type", "props", "purchase")


@query("k3_fold_whole", "SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value, max_by(props, event_id) AS props FROM events GROUP BY 1")
def fold_whole(t: Tables) -> DataFrame:
    return K.fold_whole(t.events, ["user_id"], ["event_type", "value", "props"], "event_id")


@query("k4_log_tail", "SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 200)")
def tail(t: Tables) -> DataFrame:
    return K.tail(t.events, ["event_id"], 200).select("event_id", "event_type")


@query("k5_run_segments", """
SELECT event_id, CAST(sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run_id FROM events
""")
def segments(t: Tables) -> DataFrame:
    return K.run_ids(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "run_id")


@query("k5_initial_state", """
SELECT event_type AS table_name, count(*) AS rows, 'none' AS layer, -1 AS score, count(*) AS rows_processed, 0 AS rows_quarantined FROM events GROUP BY 1
""")
def initial(t: Tables) -> DataFrame:
    stats = t.events.groupBy(F.col("event_type").alias("table_name")).agg(F.count(F.lit(1)).alias("rows"))
    return K.initial_state(stats).withColumns({"layer": F.coalesce("layer", F.lit("none")), "score": F.coalesce("score", F.lit(-1))})


@query("k6_run_summary", """
SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 3) AS duration, count(*) AS events,
  max(total_rows) AS total_rows, max(tables_processed) AS tables_processed, max(avg_score) AS avg_score
FROM events JOIN (SELECT user_id, CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS tables_processed, CAST(floor(avg(s)) AS INTEGER) AS avg_score
  FROM (SELECT user_id, event_type, count(*) AS n, CAST(floor(100.0 * count(*) FILTER (value < 30) / count(*)) AS INTEGER) AS s FROM events GROUP BY 1, 2) GROUP BY 1) USING (user_id) GROUP BY 1
""")
def summary(t: Tables) -> DataFrame:
    tables = t.events.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.floor(100.0 * F.count_if(F.col("value") < 30) / F.count(F.lit(1))).cast("int").alias("score"))
    return K.run_summary(t.events, ["user_id"], "ts", tables).withColumn("duration", F.round("duration", 3))


@query("k7_stage_durations", """
SELECT user_id, coalesce(round((epoch_us(max(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts) FILTER (event_type = 'view'))) / 1000000.0, 2), -1) AS duration FROM events GROUP BY 1
""")
def durations(t: Tables) -> DataFrame:
    out = K.stage_durations(t.events, ["user_id"], "ts", "event_type", "view", "purchase")
    return out.withColumn("duration", F.coalesce("duration", F.lit(-1.0)))
