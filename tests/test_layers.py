"""Writers, audit, layer tables, the whole run, and governance helpers."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from assay.operators import govern as G, model, ordered, profile, rules as R
from assay.plans import bank, core, health, medallion
from assay.session import cut, shared_dir
from assay.sources import layers, readers


def test_save_modes(spark, tmp_path):
    root = str(tmp_path)
    layers.write_layer(spark.range(10), root, "silver", "t", ["id"])
    layers.write_layer(spark.range(99), root, "silver", "t", mode="ignore")
    assert readers.read_layer(spark, root, "silver", "t").count() == 10
    layers.write_layer(spark.range(99), root, "silver", "t")
    assert readers.read_layer(spark, root, "silver", "t").count() == 99
    with pytest.raises(Exception):
        layers.write_layer(spark.range(1), root, "silver", "t", mode="errorifexists")


def test_clustering_splits_a_hot_value(spark, tmp_path):
    df = spark.range(4000).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        layers.write_layer(df.repartition(8), str(tmp_path), "silver", "t", ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    back = readers.read_layer(spark, str(tmp_path), "silver", "t")
    per_file = back.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == 7).alias("hot")).collect()
    assert sum(r["n"] for r in per_file) == 4000
    assert sum(r["hot"] > 0 for r in per_file) >= 4 and max(r["n"] for r in per_file) < 600


def test_bucketed_tables_join_without_shuffle(spark):
    for name, n in (("bucketed_a", 300), ("bucketed_b", 200)):
        layers.write_bucketed(spark.range(n).withColumnRenamed("id", "k"), name, ["k"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b"), "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_a")
        spark.sql("DROP TABLE bucketed_b")


def test_bronze_audit_and_months(spark, tmp_path):
    root = str(tmp_path)
    df, seen = layers.observed(layers.to_bronze(spark.range(25), "erp", "b1", "2024-01-31 06:00:00"), "load-" + uuid.uuid4().hex)
    layers.write_bronze(df, root, "t")
    audit = layers.audit_record(spark, seen, "ann", "t", "2024-01-31 06:00:00", ["ssn"])
    for run_id, part in (("1", "t"), ("1", "t"), ("2024-01", "t")):
        layers.write_report(audit, root, "load_audit", run_id, part)
    assert [(r["run_id"], r["rows"]) for r in layers.read_report(spark, root, "load_audit").orderBy("run_id").collect()] == [("1", 25), ("2024-01", 25)]
    assert (tmp_path / "bronze" / "t" / "_load_date=2024-01-31").is_dir()
    ledger = spark.range(90).select(F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("d"))
    layers.write_monthly(ledger, root, "silver", "ledger", "d")
    back = spark.read.parquet(f"{root}/silver/ledger")
    assert back.where("month = '2024-02-01'").count() == 29
    assert "PartitionFilters: [isnotnull(month" in back.where("month = DATE '2024-02-01'")._jdf.queryExecution().executedPlan().toString()


def test_records_that_do_not_parse(spark, tmp_path):
    from pyspark.sql.types import StructType
    lines = ['{"a": 1, "b": "x"}', '{"a": "no number", "b": "y"}', "not json", '{"a": 2}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "j"))
    good, bad = layers.read_records(spark, str(tmp_path / "j"), StructType.fromDDL("a int, b string"))
    assert {tuple(r) for r in good.collect()} == {(1, "x"), (2, None)} and {r["line"] for r in bad.collect()} == set(lines[1:3])
    spark.createDataFrame([("1,x",), ("z,y",), ("3",)], "value string").write.text(str(tmp_path / "c"))
    good, bad = layers.read_records(spark, str(tmp_path / "c"), StructType.fromDDL("a int, b string"), "csv")
    assert {tuple(r) for r in good.collect()} == {(1, "x")} and {r["line"] for r in bad.collect()} == {"z,y", "3"}


def specs_of(spark, broken=False):
    orders = spark.createDataFrame([(1, "c1", "5.0"), (1, "c1", "5.0"), (2, "zz", "-1.0"), (3, "c2", None), (4, "c2", "7.5")], "id int, cust string, amt string")
    fail = lambda g: (_ for _ in ()).throw(RuntimeError("lost"))
    return [medallion.TableSpec("orders", orders, ["id"], ["cust", "amt"], lambda s: [R.null_rule("amt"), R.range_rule("amt", lo=0)],
                                steps=[lambda d: d.withColumn("amt", F.col("amt").try_cast("decimal(18,2)"))],
                                features=fail if broken else lambda g: g.groupBy("cust").agg(F.sum("amt").alias("total")))]


def contents(spark, root):
    pick = lambda df: sorted(str(r) for r in df.collect())
    out = {n: pick(layers.read_report(spark, root, n)) for n in ("dq_results", "load_audit", "lineage", "metrics", "layer_scores", "alerts", "schemas", "target_model")}
    events = layers.read_report(spark, root, "run_events")
    return out | {"quarantine": pick(layers.read_quarantine(spark, root)), "events": pick(events.drop("ts")), "gold": pick(readers.read_layer(spark, root, "gold", "orders"))}


def test_a_repeated_run_leaves_one_copy_of_everything(spark, tmp_path):
    root = str(tmp_path)
    medallion.run(spark, root, specs_of(spark), "run-1", "2024-01-31 06:00:00")
    first = contents(spark, root)
    medallion.run(spark, root, specs_of(spark), "run-1", "2024-01-31 06:00:00")
    assert contents(spark, root) == first and len(first["quarantine"]) == 2


def test_a_broken_run_shows_how_far_it_came_and_can_be_repeated(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(RuntimeError, match="lost"):
        medallion.run(spark, root, specs_of(spark, broken=True), "run-1", "2024-01-31 06:00:00")
    tables, state = medallion.state(spark, root, "run-1")
    assert (state.first()["status"], state.first()["current_stage"], state.first()["stages_complete"]) == ("running", 8, 7)
    assert {r["table"]: r["layer"] for r in tables.collect()} == {"orders": "gold"}
    medallion.run(spark, root, specs_of(spark), "run-1", "2024-01-31 06:00:00")
    assert medallion.state(spark, root, "run-1")[1].first()["status"] == "complete"
    broken = contents(spark, root)
    medallion.run(spark, str(tmp_path / "other"), specs_of(spark), "run-1", "2024-01-31 06:00:00")
    assert contents(spark, str(tmp_path / "other")) == broken


@pytest.mark.parametrize("hot_rows", [ordered.HOT_ROWS, 0])
def test_no_checkpoint_holds_a_table_and_the_layers_lie_in_order(spark, tmp_path, monkeypatch, hot_rows):
    root, stored = str(tmp_path), []
    monkeypatch.setattr(ordered, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(medallion, "cut", lambda df: stored.append(cut(df)) or stored[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        rows = spark.range(12_000).selectExpr("nullif(id % 10000, 77) AS k", "id AS v", "if(id % 7 = 0, NULL, id) AS w").repartition(6)
        medallion.run(spark, root, [medallion.TableSpec("t", rows, ["k"], ["v"], lambda s: [R.null_rule("w")])], "run-1", "2024-01-31 06:00:00")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert stored and all(df.count() < 100 for df in stored) and spark.conf.get("spark.sql.files.openCostInBytes") == cost
    want = {(None if i == 77 else i, i, None if i % 7 == 0 else i) for i in range(10_000)}
    read = lambda name: [tuple(r) for r in readers.read_layer(spark, root, name, "t").collect()]
    assert len(read("silver")) == 10_000 and set(read("silver")) == want
    assert sorted(read("gold"), key=str) == sorted((r for r in want if r[2] is not None), key=str)
    assert {(r["k"], r["v"], r["w"]) for r in layers.read_quarantine(spark, root).collect()} == {r for r in want if r[2] is None}
    for name in ("silver", "gold"):
        ends = readers.read_layer(spark, root, name, "t").groupBy(F.input_file_name()).agg(F.min("k"), F.max("k")).collect()
        ends = sorted((r[1], r[2]) for r in ends)
        assert len(ends) == 4 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_large_groups_are_noticed(spark):
    rows = spark.range(6000).withColumn("k", F.lit(1)).repartition(4)
    assert ordered.crowded(rows, ["k"]) and not ordered.crowded(rows, ["id"]) and not ordered.crowded(rows.limit(0), ["k"])
    assert 0 < ordered.scouts(spark.range(200_000)).count() < 2_000


def test_whole_run(spark, tmp_path):
    root, run_id = str(tmp_path), "run-" + uuid.uuid4().hex
    orders = spark.createDataFrame([(1, "c1", "5.0"), (1, "c1", "5.0"), (2, "zz", "-1.0"), (3, "c2", None), (4, "c2", "7.5")], "id int, cust string, amt string")
    cust = spark.createDataFrame([("c1", "a@b.org"), ("c2", "bad")], "cust string, email string")
    specs = [
        medallion.TableSpec("orders", orders, ["id"], ["cust", "amt"],
                            lambda s: [R.null_rule("amt"), R.range_rule("amt", lo=0), R.Exists("fk:cust", ["cust"], cust, ["cust"])],
                            steps=[lambda d: d.withColumn("amt", F.col("amt").try_cast("decimal(18,2)"))],
                            features=lambda g: g.groupBy("cust").agg(F.sum("amt").alias("total"))),
        medallion.TableSpec("cust", cust, ["cust"], ["email"], lambda s: [R.regex_rule("email", "email")], sensitive=["email"]),
    ]
    report = medallion.run(spark, root, specs, run_id, "2024-01-31 06:00:00")
    # order 2 breaks two rules and is quarantined once
    assert {tuple(r)[:4] for r in report.collect()} == {("orders", 4, 2, 2), ("cust", 2, 1, 1)}
    bad = spark.read.parquet(f"{root}/quarantine/table=orders")
    assert {r["id"]: sorted(r["failed_rules"]) for r in bad.collect()} == {2: ["fk:cust", "range:amt"], 3: ["null_check:amt"]}
    assert {r["cust"]: float(r["total"]) for r in readers.read_layer(spark, root, "platinum", "orders").collect()} == {"c1": 5.0, "c2": 7.5}
    tables, state = medallion.state(spark, root, run_id)
    assert state.first()["status"] == "complete" and state.first()["stages_complete"] == 9 and state.first()["current_stage"] == 9
    assert {r["table"]: (r["layer"], r["score"], r["rows_quarantined"]) for r in tables.collect()}["cust"] == ("gold", 100, 1)
    scores = {(r["table_name"], r["layer"]): r["change"] for r in medallion.layer_scores(spark, root, run_id).collect()}
    assert scores[("orders", "gold")] > 0 and {k[1] for k in scores} == {"source", "bronze", "silver", "gold", "platinum"}
    assert layers.read_report(spark, root, "dq_results").count() == 4
    # the same load again leaves the layers as they are
    again = medallion.run(spark, root, specs, run_id + "b", "2024-01-31 06:00:00")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in report.collect()}
    assert readers.read_layer(spark, root, "gold", "orders").count() == 2


def test_layer_tables(spark):
    from pyspark.sql.types import StructType
    made = model.create_layer_tables(spark, {"claims": StructType.fromDDL("id string, npi string, day date")}, "silver_layer", {"claims": "day"}, {"claims": ["npi"]})
    assert made == ["silver_layer.claims"]
    desc = {(r["col_name"], r["comment"]) for r in spark.sql("DESCRIBE silver_layer.claims").collect()}
    assert ("npi", "sensitive") in desc and ("# Partition Information", "") in desc
    spark.sql("DROP TABLE silver_layer.claims")


def test_schema_profile_and_drift(spark):
    a = spark.createDataFrame([], "id int, name string, gone date")
    b = spark.createDataFrame([], "id bigint, name string, fresh double")
    rows = profile.schema_profile(spark, {"a": a}).collect()
    assert [(r["position"], r["column_name"], r["data_type"]) for r in rows] == [(1, "id", "int"), (2, "name", "string"), (3, "gone", "date")]
    drift = G.schema_drift(G.schema_rows(spark, a.schema), G.schema_rows(spark, b.schema))
    assert {(r["column_name"], r["change"]) for r in drift.collect()} == {("id", "retyped"), ("gone", "removed"), ("fresh", "added")}


def test_labels_survive_parquet(spark, tmp_path):
    df = G.label(spark.createDataFrame([("a@b.org", 1)], "email string, n int"), {"email": ["PII", "GLBA"]})
    df.select("n", "email").write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {tuple(r) for r in G.labels_of(spark, "t", back).collect()} == {("t", "email", "PII"), ("t", "email", "GLBA")}


def test_column_lineage_and_totals(spark):
    from assay.operators import graph
    edges = G.column_lineage(spark, [("clean", ["b.email"], "s.email"), ("join", ["s.email", "s.id"], "g.key")])
    assert {r["node"] for r in graph.impact(edges, spark.createDataFrame([("b.email",)], "node string")).collect()} == {"b.email", "s.email", "g.key"}
    assets = G.catalogue(spark, {"t": spark.range(3)}, "gold", spark.createDataFrame([("t", "pii")], "table_name string, tag string"))
    assert assets.first().asDict() == {"table_name": "t", "layer": "gold", "columns": 1, "rows": 3, "tag": "pii"}
    assert tuple(G.catalogue_totals(assets, edges).first()) == (1, 3)


def test_role_view_and_agreements(spark):
    df = spark.createDataFrame([("1", "Ann", 5.0)], "id string, name string, pay double")
    view = G.role_view(df, {"nurse": {"id": "show", "name": "mask", "pay": "null"}}, "nurse").first()
    assert (view["id"], view["name"], view["pay"]) == ("1", "Xxx", None)
    day = lambda s: dt.date.fromisoformat(s)
    deals = spark.createDataFrame([("x", day("2024-01-01"), day("2024-12-31")), ("y", day("2023-01-01"), day("2023-12-31")), ("z", day("2020-01-01"), None)], "c string, valid_from date, valid_to date")
    consumers = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "c string")
    assert {r["c"] for r in G.consumers_without(consumers, deals, "c", F.lit("2024-06-15").cast("date")).collect()} == {"y", "w"}


def test_regimes_and_noise(spark):
    facts = bank.fact_table(spark)
    tagged = G.tag_regimes(facts.select("table_name"), facts.select("table_name", "regimes"), "table_name")
    assert {r["table_name"] for r in tagged.where("regime = 'CRA'").collect()} == {"LOANS", "BRANCHES"}
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.lit(2.0).alias("v")).unionByName(spark.createDataFrame([(9, 1.0)], "g long, v double"))
    a, b = [{tuple(r) for r in G.noisy_aggregate(df, ["g"], "v", 1.0, 10.0, 5, seed).collect()} for seed in (1, 1)]
    assert a == b and {g for g, _, _ in a} == {0, 1, 2}
    assert all(abs(n - 333) < 60 for _, n, _ in a)
    assert a != {tuple(r) for r in G.noisy_aggregate(df, ["g"], "v", 1.0, 10.0, 5, 2).collect()}


def test_descriptors_and_phi(spark):
    flags = spark.createDataFrame([("T", "a", "email", True), ("T", "b", "email", True), ("U", "c", "email", False), ("U", "d", "ssn", False)],
                                  "table_name string, column_name string, kind string, flagged boolean")
    summary = profile.identifier_summary(flags)
    assert {tuple(r) for r in summary.collect()} == {("email", True, 1, 2), ("ssn", False, 0, 1)}
    assert tuple(profile.identifier_total(summary).first()) == (2, 1)
    assert profile.sensitive_columns(flags).first().asDict() == {"table_name": "T", "n_columns": 2, "columns": ["a", "b"]}
    counts = {r["table_name"]: r["rows"] for r in profile.table_counts({"a": spark.range(3), "gone": None}, "ALL").collect()}
    assert counts == {"a": 3, "gone": 0, "ALL": 3}


def test_fixed_lists():
    assert len(core.SCHEMAS) == len(health.SCHEMAS) == len(bank.SCHEMAS) == 8


def test_checkpoints_go_to_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named
