"""Streams over files against the batch form, with late and repeated rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assay.operators import monitor
from assay.streaming import forms

SCHEMA = "id long, user string, subject string, ts timestamp, kind string, amount double"
T0 = dt.datetime(2024, 1, 1)


def rows(n=120):
    kinds = ["view", "click", "error", "buy"]
    return [(i, "hot" if i % 3 == 0 else f"u{i % 5}", f"s{i % 11}", T0 + dt.timedelta(seconds=20 * i), kinds[(i * 7) % 4], float(i % 13)) for i in range(n)]


@pytest.fixture
def files(spark, tmp_path):
    """Three files in order of time."""
    path = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(rows()[part * 40:(part + 1) * 40], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture
def whole(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def stream(spark, files):
    return forms.file_stream(spark, files, SCHEMA, max_files=1)


def read(spark, path):
    return spark.read.parquet(path + "/batch=*")


def table(df):
    return sorted(tuple(r) for r in df.collect())


def latest(df, keys, by):
    """Last emitted line per key of an update-mode output."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), by).alias("v")).select(*keys, "v.*")


def run(spark, df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    forms.each_batch(df, lambda b, i: forms.write_batch(b.withColumn("_batch", F.lit(i)), out, i), str(tmp_path / "cp"), mode)
    return read(spark, out)


def test_incremental_extract_resumes(spark, files, tmp_path):
    out, cp = str(tmp_path / "bronze"), str(tmp_path / "cp")
    forms.drain(stream(spark, files), out, cp)
    assert spark.read.parquet(out).count() == 120
    spark.createDataFrame([(999, "u1", "s", T0, "view", 1.0)], SCHEMA).write.mode("append").parquet(files)
    forms.drain(stream(spark, files), out, cp)
    assert spark.read.parquet(out).count() == 121


def test_access_anomaly(spark, files, whole, tmp_path):
    got = run(spark, forms.access_anomaly(stream(spark, files), "ts", "user", "subject", 1, "2 minutes", "1 minute"), tmp_path).drop("_batch")
    want = monitor.access_anomaly(whole, "ts", "user", "subject", 1, "2 minutes")
    # windows the watermark has not passed stay open
    edge = T0 + dt.timedelta(seconds=20 * 119) - dt.timedelta(minutes=1)
    closed = [r for r in table(want) if r[0] + dt.timedelta(minutes=2) <= edge]
    assert closed and table(got) == closed


def test_rate_alert_sliding(spark, files, whole, tmp_path):
    args = ("ts", F.col("kind") == "error", [], 0.2, "4 minutes", "2 minutes")
    got = table(run(spark, forms.rate_alert(stream(spark, files), *args, delay="1 minute"), tmp_path).drop("_batch"))
    edge = T0 + dt.timedelta(seconds=20 * 119) - dt.timedelta(minutes=1)
    assert got and got == [r for r in table(monitor.rate_alert(whole, *args)) if r[0] + dt.timedelta(minutes=4) <= edge]


def test_dedupe_drops_repeats_and_late_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    put = lambda r: spark.createDataFrame(r, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    row = lambda i, minutes: (i, "u", "s", T0 + dt.timedelta(minutes=minutes), "view", 1.0)
    put([row(1, 0), row(2, 1), row(1, 0)])
    put([row(2, 2), row(3, 60)])
    put([row(4, 61), row(3, 60)])
    put([row(5, 1), row(6, 62)])  # row 5 is an hour late
    got = run(spark, forms.dedupe_stream(forms.file_stream(spark, path, SCHEMA, max_files=1), ["id"], "ts", "10 minutes"), tmp_path)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4, 6]


def test_monthly_counter_and_balance(spark, files, whole, tmp_path):
    got = run(spark, forms.monthly_counter(stream(spark, files), "user", "ts", 20), tmp_path / "a", "update")
    days = latest(got, ["user", "day"], "_batch")
    final = {(r["user"], r["n"], r["freeze"]) for r in forms.monthly_total(days, "user", 20).collect()}
    batch = monitor.monthly_limit(whole, "user", ["ts", "id"], 20).groupBy("user").agg(F.max("nth").alias("n"), F.bool_or("freeze").alias("f"))
    assert final == {tuple(r) for r in batch.collect()}
    got = run(spark, forms.running_balance(stream(spark, files), "user", F.col("amount")), tmp_path / "b", "update")
    final = {(r["user"], r["balance"]) for r in latest(got, ["user"], "_batch").collect()}
    last = monitor.running_balance(whole, "user", ["ts", "id"], F.col("amount")).groupBy("user").agg(F.max_by("balance", "id").alias("b"))
    assert final == {tuple(r) for r in last.collect()}


def test_routing(spark, files, whole, tmp_path):
    conds = {"errors": F.col("kind") == "error", "large": F.col("amount") > 10}
    forms.each_batch(stream(spark, files), forms.route_to(str(tmp_path / "q"), conds), str(tmp_path / "cp"))
    for name, cond in conds.items():
        assert sorted(r["id"] for r in read(spark, str(tmp_path / "q" / name)).collect()) == sorted(r["id"] for r in whole.where(cond).collect())


def test_screening_of_arrivals(spark, files, tmp_path):
    watch = spark.createDataFrame([("U1",), ("hott",)], "listed string")
    forms.each_batch(stream(spark, files), forms.screen_to(str(tmp_path / "hits"), "id", "user", watch, "listed"), str(tmp_path / "cp"))
    hits = read(spark, str(tmp_path / "hits")).collect()
    assert {r["name"] for r in hits if r["listed"] == "hott"} == {"hot"}
    assert {(r["name"], r["hit"]) for r in hits if r["listed"] == "U1"} == {("u1", "normalised")} | {(f"u{i}", "fuzzy") for i in (0, 2, 3, 4)}


def test_transitions_across_batches(spark, files, whole, tmp_path):
    allowed = [("view", "click"), ("click", "view"), ("error", "view")]
    action = forms.transitions_to(str(tmp_path / "t"), "user", ["ts", "id"], "kind", allowed)
    forms.each_batch(stream(spark, files), action, str(tmp_path / "cp"))
    got = read(spark, str(tmp_path / "t" / "illegal"))
    want = monitor.illegal_transitions(whole, "user", ["ts", "id"], "kind", allowed)
    pick = lambda df: table(df.select("id", "previous", "kind"))
    assert pick(got) == pick(want) and len(pick(got)) > 10
    # a repeated batch changes nothing, and neither does folding the state of the batches before it
    action(spark.createDataFrame(rows()[80:], SCHEMA), 2)
    assert pick(read(spark, str(tmp_path / "t" / "illegal"))) == pick(want)
    forms.compact_state(spark, str(tmp_path / "t"), "user", ["ts", "id"], 1)
    action(spark.createDataFrame(rows()[80:], SCHEMA), 2)
    assert pick(read(spark, str(tmp_path / "t" / "illegal"))) == pick(want)


def test_a_row_without_status_hides_no_change(spark, tmp_path):
    line = lambda i, s: (i, "u", "s", T0 + dt.timedelta(minutes=i), s, 1.0)
    action = forms.transitions_to(str(tmp_path / "t"), "user", ["ts", "id"], "kind", [("A", "B")])
    action(spark.createDataFrame([line(1, "A"), line(2, None)], SCHEMA), 0)
    action(spark.createDataFrame([line(3, "C")], SCHEMA), 1)
    got = read(spark, str(tmp_path / "t" / "illegal")).collect()
    assert [(r["id"], r["previous"], r["kind"]) for r in got] == [(3, "A", "C")]


def test_static_limits(spark, files, whole, tmp_path):
    limits = spark.createDataFrame([("hot", 5.0), ("u1", 100.0)], "user string, lim double")
    got = run(spark, forms.breaches(stream(spark, files), limits, "user", "amount", "lim"), tmp_path)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in whole.where("user = 'hot' AND amount > 5").collect())


def test_alert_sessions(spark, files, whole, tmp_path):
    from assay.operators.features import dedupe_alerts
    got = run(spark, forms.alert_sessions(stream(spark, files), "user", "ts", "90 seconds", "0 seconds"), tmp_path).select("user", "first_ts", "last_ts", "merged")
    want = dedupe_alerts(whole, ["user"], ["ts", "id"], 89).select("user", "first_ts", "last_ts", "merged")
    edge = T0 + dt.timedelta(seconds=20 * 119)
    assert set(table(got)) == {r for r in table(want) if r[2] + dt.timedelta(seconds=90) <= edge}
