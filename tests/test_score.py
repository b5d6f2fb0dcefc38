"""Scores fixed by arithmetic, and the score operators."""

import pytest
from pyspark.sql import functions as F

from assay.operators import rules as R, score
from assay.plans import bank

CORE = [
    ("CUSTOMERS", (58, 72, 61, 88, 95), 71), ("ORDERS", (70, 95, 75, 82, 72), 78), ("PRODUCTS", (75, 90, 80, 70, 98), 81),
    ("EMPLOYEES", (80, 97, 72, 65, 55), 75), ("FINANCIALS", (78, 88, 85, 75, 98), 83), ("INVENTORY", (82, 98, 68, 72, 78), 80),
    ("CONTRACTS", (68, 97, 74, 60, 80), 75), ("RISK_EVENTS", (62, 98, 78, 70, 72), 75),
]
HEALTH = [
    ("PATIENTS", (55, 98, 82, 95, 40), 74), ("ENCOUNTERS", (80, 98, 78, 82, 68), 82), ("DIAGNOSES", (95, 72, 82, 88, 78), 83),
    ("MEDICATIONS", (78, 75, 92, 90, 72), 80), ("LAB_RESULTS", (90, 80, 88, 92, 82), 86), ("PROCEDURES", (92, 78, 88, 90, 80), 85),
    ("CLAIMS", (88, 85, 82, 88, 75), 84), ("PROVIDERS", (82, 82, 98, 95, 85), 87),
]


@pytest.mark.parametrize("golden, weights", [(CORE, score.CORE_WEIGHTS), (HEALTH, score.HEALTH_WEIGHTS)])
def test_readiness_goldens(spark, golden, weights):
    df = spark.createDataFrame([(t, *v) for t, v, _ in golden], "table_name string, " + ", ".join(f"{c} int" for c in weights))
    got = {r["table_name"]: r["score"] for r in score.readiness(df, weights).collect()}
    assert got == {t: s for t, _, s in golden}


@pytest.mark.parametrize("gold, want", [
    ((91, 89, 92, 88, 90, 93, 87, 88), 89), ((89, 88, 91, 89, 92, 90, 91, 93), 90), ((95, 96, 97, 95, 96, 96, 95, 97), 95)])
def test_overall_is_truncated_mean(spark, gold, want):
    assert score.overall(spark.createDataFrame([(g,) for g in gold], "score int")).first()[0] == want


def test_bank_weights(spark):
    assert all(sum(w.values()) == 100 for w in bank.WEIGHTS.values())
    weights = bank.weight_table(spark)
    full = weights.select("table_name", "factor", F.lit(90.5).alias("value"))
    assert {r["score"] for r in score.readiness_by_table(full, weights).collect()} == {90}


def test_status_bands_and_empty_table(spark):
    df = spark.createDataFrame([(10000, 500), (10000, 501), (10000, 2000), (10000, 2001), (0, 0)], "rows long, failed long")
    got = [(r["status"], r["pass_rate"], r["severity"]) for r in R.outcome(df).collect()]
    assert got == [("PASS", 95.0, "warn"), ("WARN", 95.0, "warn"), ("WARN", 80.0, "error"), ("FAIL", 80.0, "error"), ("FAIL", 0.0, "info")]


def test_pass_rate_rounds_half_up(spark):
    df = spark.createDataFrame([(2000, 1), (3, 1), (1, 0)], "rows long, failed long")
    assert [r["pass_rate"] for r in R.outcome(df).collect()] == [100.0, 66.7, 100.0]
    assert [r["severity"] for r in R.outcome(df, graded=False).collect()] == ["warn", "warn", "info"]


def test_layers_gaps_exposure(spark):
    s = spark.createDataFrame([("T", "gold", 87), ("T", "source", 40), ("T", "silver", 60), ("T", "bronze", 45), ("T", "platinum", 80)],
                              "table_name string, layer string, score int")
    assert [r["layer"] for r in score.regressions(s).collect()] == ["platinum"]
    changes = {r["layer"]: r["change"] for r in score.layer_scores(s).collect()}
    assert changes == {"source": 0, "bronze": 5, "silver": 15, "gold": 27, "platinum": -7}
    c = s.withColumnRenamed("score", "compliance_score")
    assert {r["layer"]: r["exposure"] for r in score.exposure(c).collect()}["bronze"] == "exposed"
    found = score.gaps(c, 80)
    assert tuple(score.gap_summary(found).first()) == (3, 1)
    assert {r["layer"]: r["gap"] for r in found.collect()} == {"source": 40, "bronze": 35, "silver": 20}


def test_compliance_score(spark):
    results = spark.createDataFrame([("T", "a", 90.0), ("T", "b", 50.0), ("U", "a", 99.9)], "table_name string, rule_id string, pass_rate double")
    weights = spark.createDataFrame([("a", 3), ("b", 1)], "rule_id string, weight int")
    assert {tuple(r) for r in score.compliance_score(results, weights).collect()} == {("T", 80), ("U", 99)}


def test_improvement_paths_only_for_open_rules(spark):
    catalogue = score.expand_catalogue(bank.repair_catalogue(spark))
    results = spark.createDataFrame([("CARDS", "invalid_luhn", 50.0, "FAIL"), ("CARDS", "expired_active", 99.0, "PASS"), ("LOANS", "missing_ltv", 85.0, "WARN")],
                                    "table_name string, rule_id string, pass_rate double, status string")
    got = {(r["table_name"], r["transition"], r["rule_id"], r["step"]) for r in score.improvement_paths(results, catalogue).collect()}
    assert got == {("CARDS", "bronze_to_silver", "invalid_luhn", 1), ("LOANS", "bronze_to_silver", "missing_ltv", 2)}


def test_health_factors(spark):
    from assay.plans import health
    results = spark.createDataFrame([("CLAIMS", "claim_integrity", 88.0), ("CLAIMS", "date_coherence", 95.0)], "table_name string, rule_id string, pass_rate double")
    row = score.measure_health_factors(results, health.FACTOR_RULES).first()
    assert (row["clinical_code_validity"], row["temporal_coherence"], row["phi_completeness"]) == (88.0, 95.0, 100.0)
