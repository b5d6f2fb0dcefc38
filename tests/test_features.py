"""Text, vector, encoding and alert features on small tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from assay.operators import events as K, features as H, monitor as I, rules as R


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, "a b\n c"), (3, "   "), (4, None), (5, "x y z w")], "id int, t string")
    plain = {(r["id"], r["chunk_no"]): r["chunk"] for r in H.chunk_text(df, "id", "t", 4).collect()}
    assert plain == {(1, 0): "0 1 2 3", (1, 1): "4 5 6 7", (1, 2): "8 9", (2, 0): "a b c", (5, 0): "x y z w"}
    lapped = {(r["id"], r["chunk_no"]): r["chunk"] for r in H.chunk_text(df, "id", "t", 4, 1).collect()}
    assert lapped == {(1, 0): "0 1 2 3", (1, 1): "3 4 5 6", (1, 2): "6 7 8 9", (2, 0): "a b c", (5, 0): "x y z w"}


@pytest.mark.parametrize("ngram", [1, 2, 3])
def test_hashed_vectors(spark, ngram):
    df = spark.createDataFrame([(1, "The quick brown fox"), (2, "the QUICK, brown fox!"), (3, "something else entirely"), (4, ""), (5, None), (6, "one")], "id int, t string")
    v = {r["id"]: r["vector"] for r in H.hash_embed(df, "id", "t", 64, ngram).collect()}
    assert len(v) == 6 and all(len(x) == 64 for x in v.values())
    assert v[1] == v[2] != v[3]
    assert all(math.isclose(math.hypot(*v[i]), 1.0) for i in (1, 3, 6)) and set(v[4]) == set(v[5]) == {0.0}


def test_word_order_matters_to_bigrams_only(spark):
    df = spark.createDataFrame([(1, "man bites dog"), (2, "dog bites man")], "id int, t string")
    one, two = [[r["vector"] for r in H.hash_embed(df, "id", "t", 128, n).orderBy("id").collect()] for n in (1, 2)]
    assert one[0] == one[1] and two[0] != two[1]


def test_similarity_scaling_encoding(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [2.0, 2.0])], "l string, v array<double>")
    assert {r["l"]: r["centroid"] for r in H.centroids(df, "l", "v").collect()} == {"a": [0.5, 0.5], "b": [2.0, 2.0]}
    n = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    assert [(r["x_norm"], r["c_norm"]) for r in H.normalise(n, ["x", "c"]).collect()] == [(-1.0, None), (1.0, None), (None, None)]
    assert [r["x_norm"] for r in H.normalise(n, ["x"], "minmax").collect()] == [0.0, 1.0, None]
    s = spark.createDataFrame([("LOW",), ("CRITICAL",), (None,), ("?",)], "s string")
    got = [(r["s_code"], r["s_onehot"]) for r in H.encode(s, "s", ["LOW", "HIGH", "CRITICAL"]).collect()]
    assert got == [(1, [1, 0, 0]), (3, [0, 0, 1]), (0, [0, 0, 0]), (0, [0, 0, 0])]
    bands = H.risk_vector(spark.createDataFrame([(10,), (50,), (51,)], "p int"), {"p": F.col("p")}, [(10, "L"), (50, "M"), (100, "H")]).collect()
    assert [(r["band"], r["vector"]) for r in bands] == [("L", [10.0]), ("M", [50.0]), ("H", [51.0])]


def test_bursts_and_typologies(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(i, "k", t(s)) for i, s in enumerate((0, 60, 120, 181, 400))], "id int, k string, ts timestamp")
    got = [(r["session"], r["merged"]) for r in H.dedupe_alerts(df, ["k"], ["ts", "id"], 60).orderBy("session").collect()]
    assert got == [(1, 3), (2, 1), (3, 1)]
    tags = H.tag_typology(df, {"a": F.col("id") > 1, "b": F.col("id") > 2}).orderBy("id").collect()
    assert [r["typologies"] for r in tags] == [[], [], ["a"], ["a", "b"], ["a", "b"]]


def test_volume_freshness_velocity(spark):
    counts = spark.createDataFrame([(d, n) for d, n in enumerate([100, 102, 98, 100, 160, 101])], "day int, rows long")
    assert [r["day"] for r in R.volume_rule(counts, "day").where("anomaly").collect()] == [4]
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1, h),) for h in (0, 12, 23)], "ts timestamp")
    row = R.freshness_rule(ts, "ts", "2024-01-02 00:00:00").first()
    assert (row["age_seconds"], row["stale_rows"], row["fresh"]) == (3600, 0, True)
    row = R.freshness_rule(ts, "ts", "2024-01-02 00:00:01").first()
    assert (row["stale_rows"], row["fresh"]) == (1, True)
    tx = spark.createDataFrame([("a", dt.datetime(2024, 1, d), 100.0) for d in (1, 2, 3)] + [("b", dt.datetime(2024, 1, 1), 5000.0)], "acc string, ts timestamp, amt double")
    over = R.velocity_rule(tx, "acc", "ts", F.col("amt"), {"24h": (86400, 1, 1000.0), "7d": (7 * 86400, 2, 1e9)}).collect()
    flags = {(r["acc"], dt.datetime.fromtimestamp(r["tick"], dt.timezone.utc).day): (r["over_24h"], r["over_7d"]) for r in over}
    assert flags == {("a", 1): (False, False), ("a", 2): (False, False), ("a", 3): (False, True), ("b", 1): (True, False)}


def test_monthly_limit_and_transitions(spark):
    df = spark.createDataFrame([(i, "a", dt.datetime(2024, 1 + i // 8, 1 + i % 8)) for i in range(16)], "id int, acc string, ts timestamp")
    assert sorted(r["id"] for r in I.monthly_limit(df, "acc", ["ts", "id"], 6).where("freeze").collect()) == [6, 7, 14, 15]
    card = spark.createDataFrame([(1, "k", "ACTIVE"), (2, "k", "SUSPENDED"), (3, "k", "SUSPENDED"), (4, "k", "CLOSED"), (5, "k", "ACTIVE")], "id int, k string, s string")
    bad = I.illegal_transitions(card, "k", ["id"], "s", [("ACTIVE", "SUSPENDED"), ("SUSPENDED", "CLOSED")]).collect()
    assert [(r["previous"], r["s"]) for r in bad] == [("CLOSED", "ACTIVE")]


def test_event_fold(spark):
    rows = [(1, "stage_start", 1, None, None, None), (2, "table_update", None, "T", "source", 40), (3, "stage_complete", 1, None, None, None),
            (4, "stage_start", 2, None, None, None), (5, "table_update", None, "T", None, 55), (6, "table_update", None, "U", "bronze", None)]
    ev = spark.createDataFrame(rows, "seq int, type string, stage int, table string, layer string, score int").withColumn("run", F.lit("r"))
    assert {tuple(r) for r in K.fold_tables(ev).collect()} == {("T", "source", 55), ("U", "bronze", None)}
    run = K.fold_run(ev, ["run"], "seq").first()
    assert (run["current_stage"], run["stages_complete"], run["status"]) == (2, 1, "running")
    assert {tuple(r) for r in K.fold_whole(ev.where("table IS NOT NULL"), ["table"], ["layer", "score"], "seq").collect()} == {("T", None, 55), ("U", "bronze", None)}
    assert [r["seq"] for r in K.tail(ev, ["seq"], 3).collect()] == [4, 5, 6]
    assert [(r["stage"], r["position"]) for r in K.completed_stages(ev, ["run"], ["seq"]).collect()] == [(1, 1)]
