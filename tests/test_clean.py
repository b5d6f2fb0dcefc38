"""Cleansing, de-identification and loading on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assay.functions import columns as fx, patterns
from assay.operators import clean, deid, rules as R
from assay.sources import layers, readers


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def col(spark, rows, kind="string"):
    return spark.createDataFrame([(r,) for r in rows], f"x {kind}")


def test_phone_and_email(spark):
    df = col(spark, ["(212) 555-0100", "+44 20 7946 0958", "1-212-555-0100", "12345", None, "+1-999-123-4567"])
    assert values(df, fx.e164("x")) == ["+12125550100", "+442079460958", "+12125550100", None, None, "+19991234567"]
    df = col(spark, [" John.Doe@Example.COM ", "johndoeexamplecom", "a@b", None])
    assert values(df, fx.clean_email("x")) == ["john.doe@example.com", "johndoeexamplecom", "a@b", None]
    assert values(df, fx.valid_email(fx.clean_email("x"))) == [True, False, False, None]


def test_dates_names_addresses(spark):
    df = col(spark, ["2024-02-29", "29/02/2024", "Feb 29, 2024", "2023-02-29", None])
    assert values(df, fx.std_date("x", ["yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy"])) == [dt.date(2024, 2, 29)] * 3 + [None] * 2
    assert values(col(spark, ["  mARY   ann "]), fx.std_name("x")) == ["Mary Ann"]
    assert values(col(spark, ["12 north Main Street, Suite 5", "12 N. Main St Ste 5"]), fx.std_address("x")) == ["12 N MAIN ST STE 5"] * 2
    assert values(col(spark, ["02/2024", "13/2024", None]), fx.month_end("x")) == [dt.date(2024, 2, 29), None, None]


def test_check_digits(spark):
    assert values(col(spark, ["4111111111111111", "4111111111111112", "x", None]), fx.luhn_ok("x")) == [True, False, False, None]
    assert values(col(spark, ["021000021", "021000022", "21000021", "abc", None]), fx.aba_ok("x")) == [True, False, False, False, False]
    assert values(col(spark, ["1234567893", "1234567890", "123"]), fx.npi_ok("x")) == [True, False, False]
    assert values(col(spark, ["DEUTDEFF", "DEUTDEFF500", "BNKUSAB", None]), fx.bic_ok("x")) == [True, True, False, None]


def test_age_zip_expiry(spark):
    df = col(spark, ["1934-06-15", "1934-06-16", "2000-01-01", "2030-01-01", None])
    assert values(df, fx.age_band("x", "2024-06-15")) == ["90+", "80-89", "20-29", None, None]
    assert values(col(spark, ["03601", "10001", None]), fx.zip3("x", ["036"])) == ["000", "100", None]
    got = clean.expiring(col(spark, ["2024-01-01", "2024-06-20", "2025-01-01", None]), "x", "2024-06-15", 30)
    assert [r["alert"] for r in got.collect()] == ["EXPIRED", "EXPIRING", "VALID", "UNKNOWN"]


def test_expire_cards(spark):
    cards = spark.createDataFrame([("05/2024", "ACTIVE"), ("06/2024", "ACTIVE"), ("05/2024", "CLOSED"), ("xx", "ACTIVE")], "expiry_date string, status string")
    assert [(r["status"], r["status_changed"]) for r in clean.expire_cards(cards, "2024-06-15").collect()] == [
        ("EXPIRED", True), ("ACTIVE", False), ("CLOSED", False), ("ACTIVE", False)]


def test_insert_or_ignore_is_idempotent(spark):
    batch = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "k int, v string, seq int")
    once = layers.insert_or_ignore(None, batch, ["k"], ["seq"])
    assert {(r["k"], r["v"]) for r in once.collect()} == {(1, "a"), (2, "c")}
    more = spark.createDataFrame([(2, "z", 4), (3, "d", 5)], "k int, v string, seq int")
    twice = layers.insert_or_ignore(layers.insert_or_ignore(once, more, ["k"], ["seq"]), more, ["k"], ["seq"])
    assert {(r["k"], r["v"]) for r in twice.collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_composite_dedupe(spark):
    df = spark.createDataFrame([(1, "Ann", "Lee", "1990-01-01", "123-45-6789"), (2, "ANN", "lee", "1990-01-01", "999-99-6789"),
                                (3, "Ann", "Lee", "1990-01-02", "123-45-6789")], "id int, first string, last string, dob string, ssn string")
    keys = {"n": fx.match_text(F.concat_ws(" ", "first", "last")), "d": F.col("dob"), "s": F.right("ssn", F.lit(4))}
    assert {r["id"] for r in clean.dedupe_on(df, keys, ["id"]).collect()} == {1, 3}


def test_scd2_merge_closes_opens_and_repeats(spark):
    schema = "k int, city string, valid_from date, valid_to date, is_current boolean"
    day = lambda m: dt.date(2024, m, 1)
    dim = spark.createDataFrame([(1, "A", day(1), None, True), (2, "B", day(1), None, True), (3, None, day(1), None, True), (4, "D", day(1), day(2), False)], schema)
    batch = spark.createDataFrame([(1, "A", day(3)), (2, "BB", day(3)), (3, None, day(3)), (4, "D", day(3)), (5, "E", day(3))], "k int, city string, ts date")
    once = clean.scd2_merge(dim, batch, "k", ["city"], "ts")
    want = {(1, "A", day(1), None, True), (2, "B", day(1), day(3), False), (2, "BB", day(3), None, True), (3, None, day(1), None, True),
            (4, "D", day(1), day(2), False), (4, "D", day(3), None, True), (5, "E", day(3), None, True)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in clean.scd2_merge(once, batch, "k", ["city"], "ts").collect()} == want


def test_impute_strategies(spark):
    df = spark.createDataFrame([(1, None, "g"), (2, 4.0, "g"), (3, 8.0, "g"), (4, 8.0, "h"), (5, None, None)], "id int, v double, g string")
    run = lambda how: {r["id"]: r["v"] for r in clean.impute(df, {"v": how}).collect()}
    assert run(("constant", 0.0))[1] == 0.0
    assert run(("mean",))[1] == pytest.approx(20 / 3)
    assert run(("median",))[5] == 8.0 and run(("mode",))[5] == 8.0
    assert run(("group_mean", "g"))[1] == 6.0 and run(("group_mean", "g"))[5] is None
    flagged = clean.impute(df, {"v": ("flag",)})
    assert flagged.where("v IS NULL").count() == 2 and clean.imputed_counts(flagged, ["v"]).first()["v"] == 2


def test_ltv_uses_latest_appraisal(spark):
    loans = spark.createDataFrame([(1, 80.0, 100.0), (2, 50.0, None), (3, 50.0, 0.0)], "loan_id int, outstanding_balance double, collateral_value double")
    seen = spark.createDataFrame([(1, "2024-01-01", 160.0), (1, "2024-02-01", 200.0), (1, "2025-01-01", 50.0)], "loan_id int, appraised_on string, value double")
    assert {r["loan_id"]: r["ltv_current"] for r in clean.ltv(loans, seen, "2024-12-31").collect()} == {1: 40.0, 2: None, 3: None}
    assert {r["loan_id"]: r["ltv_current"] for r in clean.ltv(loans).collect()} == {1: 80.0, 2: None, 3: None}


def test_reconcile_and_closed_activity(spark):
    acc = spark.createDataFrame([("a", 10.0, "OPEN"), ("b", -5.0, "CLOSED"), ("c", 3.0, "CLOSED")], "id string, balance double, status string")
    led = spark.createDataFrame([("a", 4.0), ("a", 6.0), ("b", 1.0), ("z", 1.0)], "acc string, amt double")
    got = {r["account"]: (r["outcome"], r["negative"]) for r in clean.reconcile(acc, "id", "balance", led, "acc", F.col("amt").cast("decimal(18,2)")).collect()}
    assert got == {"a": ("ok", False), "b": ("mismatch", True), "c": ("no_ledger", False), "z": ("no_account", False)}
    assert [(r["id"], r["activity"]) for r in clean.activity_on_closed(acc, "id", "status", led, "acc", ["CLOSED"]).collect()] == [("b", 1)]


def test_address_mismatch(spark):
    ours = spark.createDataFrame([("b1", "12 North Main Street"), ("b2", "7 Oak Ave"), ("b3", "1 Elm St")], "branch_id string, address string")
    filed = spark.createDataFrame([("b1", "12 N. Main St."), ("b2", "9 Oak Avenue")], "branch_id string, filed string")
    got = {r["branch_id"]: (r["distance"], r["mismatch"]) for r in clean.address_diff(ours, "branch_id", "address", filed, "filed").collect()}
    assert got == {"b1": (0, False), "b2": (1, True), "b3": (None, True)}


def test_delinquency_bounds(spark):
    df = spark.createDataFrame([("2024-01-31", d) for d in ("2024-01-30", "2024-01-31", "2024-02-01", "2024-02-29", "2024-03-01", "2024-03-30", "2024-03-31", "2024-04-30")],
                               "due string, paid string")
    assert [r["bucket"] for r in clean.delinquency(df, "due", "paid").collect()] == ["CURRENT", "CURRENT", "1-29", "1-29", "30-59", "30-59", "60-89", "90+"]


def test_narratives_and_scores(spark):
    df = spark.createDataFrame([(1, "Suspicious activity detected.", None), (2, "one two three four five six", 20.0), (3, None, None), (4, "   ", 1.0)], "id int, text string, score double")
    assert [r["words"] for r in clean.narrative_check(df, "text", 5).collect()] == [3, 6, None, 0]
    got = clean.enrich_narrative(df, "text", 5, "Event %s scored %s.", ["id", "score"]).collect()
    assert got[0]["text"].endswith("Event 1 scored unknown.") and got[1]["text"] == "one two three four five six"
    scored = clean.impute_score(df, [("short", F.length("text") < 40, 70), ("first", F.col("id") == 1, 50)], "score").collect()
    assert (scored[0]["score"], scored[0]["score_parts"], scored[1]["score"], scored[2]["score"]) == (100.0, ["short=70", "first=50"], 20.0, 0.0)


def test_derived_values(spark):
    df = spark.createDataFrame([(100.0, 60.0, 40.0), (100.0, 120.0, 0.0), (100.0, 60.0, 39.0), (100.0, 60.0, None), (None, 60.0, None)],
                               "allowed double, paid double, liability double")
    got = clean.check_derived(df, "liability", F.greatest(F.col("allowed") * 1 - F.col("paid"), F.when(F.col("allowed").isNotNull(), 0.0)), 0.01)
    assert [r["liability_inconsistent"] for r in got.collect()] == [False, False, True, True, False]


def test_promotion_balances(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, -1), (3, 7), (3, 7)], "k int, v int")
    out, bad, stats = clean.promote(df, ["k"], ["v"], [R.range_rule("v", lo=0)])
    assert tuple(stats.first()) == (5, 2, 2, 1, True) and out.count() == 2 and bad.count() == 1


def test_dead_letter_reasons(spark):
    from pyspark.sql.types import StructType
    df = spark.createDataFrame([("1", "2.50", "2024-01-01"), ("x", "2", "2024-01-01"), ("2", None, "2024-13-01"), ("3", "oops", None)], "id string, amt string, d string")
    good, bad = layers.split_dead_letter(df, StructType.fromDDL("id int, amt decimal(18,2), d date"), {"d": "yyyy-MM-dd"}, ["amt"])
    assert [(r["id"], str(r["amt"]), r["d"]) for r in good.collect()] == [(1, "2.50", dt.date(2024, 1, 1))]
    assert sorted(r["reject_reason"] for r in bad.collect()) == ["amt: not a decimal(18,2)", "d: not a date; amt: missing", "id: not a int"]


def test_tokens_are_stable_and_vault_apart(spark):
    df = spark.createDataFrame([(1, "4111111111111111"), (2, "4111111111111111"), (3, None)], "id int, pan string")
    out, vault = deid.tokenise(df, "pan", "k1")
    rows = out.collect()
    assert rows[0]["pan_token"] == rows[1]["pan_token"] and rows[0]["pan_last4"] == "1111" and "pan" not in out.columns
    assert vault.count() == 1 and rows[2]["pan_token"] is None
    assert deid.tokenise(df, "pan", "k2")[0].first()["pan_token"] != rows[0]["pan_token"]
    with pytest.raises(ValueError):
        deid.token_key(spark, "assay.token.unset")


def test_safe_harbor_leaves_no_identifier(spark):
    text = "Call (212) 555-0100 or mail a.b@c.org from 10.0.0.1, ssn 123-45-6789, card 4111 1111 1111 1111, see https://x.org/a?b=1"
    df = spark.createDataFrame([(text, "Ann", "1990-05-06", "10001", "secret")], "note string, name string, dob string, zip string, img string")
    out = deid.safe_harbor(df, {"note": "text", "name": "mask", "dob": "year", "zip": "zip3", "img": "drop"}).first()
    for p in (patterns.EMAIL, patterns.PHONE, patterns.SSN, patterns.CARD, patterns.IP, patterns.URL):
        import re
        assert not re.search(p, out["note"])
    assert (out["name"], out["dob"], out["zip"]) == ("Xxx", 1990, "100") and "img" not in out.asDict()
    assert len(deid.SAFE_HARBOR) == 18


def test_date_shift_keeps_intervals(spark):
    df = spark.createDataFrame([("p1", "2024-01-01", "2024-01-11"), ("p1", "2024-03-01", "2024-03-02"), ("p2", "2024-01-01", "2024-01-01")], "pid string, a string, b string")
    out = deid.shift_dates(df, ["a", "b"], fx.key_days("pid", "secret")).collect()
    assert [(r["b"] - r["a"]).days for r in out] == [10, 1, 0] and (out[1]["a"] - out[0]["a"]).days == 60
    rare = deid.rare_to_year(df, "pid", ["a"], 2).collect()
    assert {(r["pid"], str(r["a"])) for r in rare} == {("p1", "2024-01-01"), ("p1", "2024-03-01"), ("p2", "2024-01-01")}


def test_readers(spark, tmp_path):
    spark.range(1000).withColumn("v", F.col("id") % 7).write.parquet(str(tmp_path / "t.parquet"))
    df = readers.read_table(spark, str(tmp_path), "t", "id bigint, v bigint")
    parts = readers.range_extract(df, "id", 8).groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("lo").collect()
    assert len(parts) == 8 and all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:]))
    plan = readers.chunk_plan(df, "v", 300).orderBy("chunk_id").collect()
    assert [(r["rows"], r["rows_done"]) for r in plan] == [(300, 300), (300, 600), (300, 900), (100, 1000)]
    assert readers.estimated_chunks(50_000, 15_000) == 3 and readers.estimated_chunks(10, 15_000) == 1
    fresh, mark = readers.incremental(df, "id", 990)
    assert fresh.count() == 9 and mark.first()[0] == 999
    assert readers.incremental(df, "id", 5000)[1].first()[0] == 5000
    assert sum(r["count"] for r in df.groupBy(readers.range_bucket("id", 0, 999, 8)).count().collect()) == 1000
