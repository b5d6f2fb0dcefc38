"""Rule sets of the three table families on small tables with one defect per row."""

import datetime as dt

from pyspark.sql import functions as F

from assay.operators import features_banking as B, features_clinical as C, model, profile, rules as R
from assay.plans import bank, core, health
from tests import samples

AS_OF = "2024-06-15"


def table(spark, schemas, name, base, *changes):
    """First row as given, then one row per change."""
    cols = [c.strip().split()[0] for c in schemas[name].split(",")]
    rows = [tuple({**base, **ch}.get(c) for c in cols) for ch in ({}, *changes)]
    return spark.createDataFrame(rows, schemas[name])


def failing(df, rules, key):
    return {r[key]: set(r["failed_rules"]) for r in R.judge(df, rules).collect() if r["failed_rules"]}


def test_health_rules(spark):
    t = {}
    pat = dict(patient_id="p1", mrn="m1", ssn="123-45-6789", phone="(212) 555-0100", email="a@b.org", dob="1980-01-01", created_date="2020-01-01", updated_date="2021-01-01",
               first_name="A", last_name="B", gender="F", payer="Aetna", zip="10001", city="X", state="NY", address="1 Elm St")
    t["PATIENTS"] = table(spark, health.SCHEMAS, "PATIENTS", pat, dict(patient_id="p2", mrn="m2", dob="2030-01-01"), dict(patient_id="p3", mrn="m3", ssn=None),
                          dict(patient_id="p4", mrn="m1"), dict(patient_id="p5", mrn="m5", ssn="INVALID-SSN"))
    enc = dict(encounter_id="e1", patient_id="p1", provider_id="v1", admit_date="2024-01-01", discharge_date="2024-01-03", drg_code="470", status="COMPLETED")
    t["ENCOUNTERS"] = table(spark, health.SCHEMAS, "ENCOUNTERS", enc, dict(encounter_id="e2", discharge_date="2023-12-30"), dict(encounter_id="e3", patient_id="PAT-INVALID-1"),
                            dict(encounter_id="e4", discharge_date=None), dict(encounter_id="e5", admit_date="2024-01-03", discharge_date="2024-01-03"))
    dx = dict(diagnosis_id="d1", encounter_id="e1", patient_id="p1", provider_id="v1", icd10_code="E11.9", onset_date="2023-01-01", resolution_date=None)
    t["DIAGNOSES"] = table(spark, health.SCHEMAS, "DIAGNOSES", dx, dict(diagnosis_id="d2", icd10_code="XYZ123"), dict(diagnosis_id="d3", icd10_code=None),
                           dict(diagnosis_id="d4", resolution_date="2022-12-31"), dict(diagnosis_id="d5", icd10_code="E11.8"))
    med = dict(medication_id="m1", patient_id="p1", encounter_id="e1", provider_id="v1", ndc_code="00006-0963-54", dose="5", drug_name="Warfarin 5mg", status="ACTIVE",
               start_date="2024-01-01", end_date="2024-02-01")
    t["MEDICATIONS"] = table(spark, health.SCHEMAS, "MEDICATIONS", med, dict(medication_id="m2", dose="25"), dict(medication_id="m3", dose="26"), dict(medication_id="m4", dose="x"),
                             dict(medication_id="m5", ndc_code="12345"))
    lab = dict(lab_id="l1", patient_id="p1", encounter_id="e1", loinc_code="2823-3", result_value=4.0, reference_low=3.5, reference_high=5.0, collection_date="2024-01-01",
               result_date="2024-01-01")
    t["LAB_RESULTS"] = table(spark, health.SCHEMAS, "LAB_RESULTS", lab, dict(lab_id="l2", result_value=15.0), dict(lab_id="l3", result_value=15.01), dict(lab_id="l4", result_value=-1.0),
                             dict(lab_id="l5", loinc_code="9999-9"), dict(lab_id="l6", result_date="2023-12-31"))
    t["PROVIDERS"] = table(spark, health.SCHEMAS, "PROVIDERS", dict(provider_id="v1", npi="1234567893", state_license="x", dea_number="y"), dict(provider_id="v2", npi="123"),
                           dict(provider_id="v3", dea_number=None))
    t["PROCEDURES"] = table(spark, health.SCHEMAS, "PROCEDURES", dict(procedure_id="c1", encounter_id="e1", patient_id="p1", provider_id="v1", cpt_code="G0463", procedure_date=AS_OF),
                            dict(procedure_id="c2", cpt_code="AB123"), dict(procedure_id="c3", procedure_date="2025-01-01"))
    clm = dict(claim_id="k1", patient_id="p1", encounter_id="e1", provider_id="v1", payer="Aetna", claim_date="2024-01-05", service_date="2024-01-05", billed_amount=100.0, paid_amount=100.0,
               claim_status="PAID", npi="1234567890")
    t["CLAIMS"] = table(spark, health.SCHEMAS, "CLAIMS", clm, dict(claim_id="k2", paid_amount=100.01), dict(claim_id="k3", npi="123"), dict(claim_id="k4", claim_date="2024-01-04"),
                        dict(claim_id="k5", claim_status="DENIED"), dict(claim_id="k6", claim_status="DENIED", denial_reason="Not Covered"), dict(claim_id="k7", claim_status="WHAT"))
    codes, doses, bounds = samples.tables(spark)
    t = health.prepare(t, doses, bounds)
    rules = health.rules(t, AS_OF, codes)
    got = {n: failing(t[n], rules[n], health.KEYS[n]) for n in rules}
    assert got == {
        "PATIENTS": {"p1": {"patient_dedup_mpi"}, "p4": {"patient_dedup_mpi"}, "p2": {"date_coherence"}, "p3": {"phi_completeness"}, "p5": {"phi_completeness"}},
        "ENCOUNTERS": {"e2": {"date_coherence"}, "e3": {"fk:patient_id"}},
        "DIAGNOSES": {"d2": {"code_validity", "code_known"}, "d3": {"code_validity", "code_known"}, "d4": {"date_coherence"}, "d5": {"code_known"}},
        "MEDICATIONS": {"m3": {"medication_safety"}, "m4": {"medication_safety"}, "m5": {"code_validity", "code_known"}},
        "LAB_RESULTS": {"l3": {"lab_range"}, "l4": {"lab_range"}, "l5": {"code_known"}, "l6": {"date_coherence"}},
        "PROVIDERS": {"v2": {"npi_format"}, "v3": {"phi_completeness"}},
        "PROCEDURES": {"c2": {"code_validity", "code_known"}, "c3": {"date_coherence"}},
        "CLAIMS": {"k2": {"claim_integrity"}, "k3": {"claim_integrity"}, "k4": {"claim_integrity", "date_coherence"}, "k5": {"claim_integrity"}, "k7": {"accepted:claim_status"}},
    }
    # counted outcomes agree with the judged rows
    for n in rules:
        counted = {r["rule_id"]: r["failed"] for r in R.run_rules(t[n], n, rules[n]).collect()}
        assert counted == {r.id: sum(r.id in f for f in got[n].values()) for r in rules[n]}
    # every clinical table has its resource document
    for n in health.SCHEMAS:
        doc = model.to_fhir(t[n], n).select("id", F.to_json("resource").alias("j")).first()
        assert f'"resourceType":"{model.FHIR_RESOURCES[n]}"' in doc["j"] and doc["id"]


def test_bank_rules(spark):
    t = {}
    cust = dict(customer_id="c1", first_name="Ann", last_name="Lee", dob="1980-01-01", ssn="123-45-6789", email="a@b.org", state="NY", zip_code="10001", kyc_date="2023-01-01", kyc_status="VERIFIED")
    t["CUSTOMERS"] = table(spark, bank.SCHEMAS, "CUSTOMERS", cust, dict(customer_id="c2", first_name="Bob", ssn=None), dict(customer_id="c3", first_name="Cy", email="INVALID_EMAIL_1"),
                           dict(customer_id="c4", first_name="Di", zip_code=None, kyc_status="PENDING"), dict(customer_id="c5"))
    acc = dict(account_id="a1", customer_id="c1", account_type="SAVINGS", product_code="SAV001", balance=10.0, available_balance=10.0, currency="USD", interest_rate=1.0,
               last_activity_date="2024-06-01", status="ACTIVE", dormant_flag=0, branch_id="b1", credit_limit=1000.0)
    t["ACCOUNTS"] = table(spark, bank.SCHEMAS, "ACCOUNTS", acc, dict(account_id="a2", balance=-1.0, available_balance=0.0), dict(account_id="a3", account_type="CREDIT", balance=-1.0, available_balance=0.0),
                          dict(account_id="a4", interest_rate=None), dict(account_id="a5", account_type="CHECKING", interest_rate=None), dict(account_id="a6", last_activity_date="2023-06-15"),
                          dict(account_id="a7", last_activity_date="2023-06-15", dormant_flag=1), dict(account_id="a8", last_activity_date="2023-06-16"),
                          dict(account_id="a9", product_code=None, status="CLOSED", branch_id="b2"), dict(account_id="a10", customer_id="zz"))
    tx = dict(transaction_id="t1", account_id="a1", amount=12.5, currency="USD", merchant_category_code="5411", transaction_date="2024-06-01 10:00:00", aml_flag=0)
    t["TRANSACTIONS"] = table(spark, bank.SCHEMAS, "TRANSACTIONS", tx, dict(transaction_id="t2", amount=5000.0), dict(transaction_id="t3", merchant_category_code=None),
                              dict(transaction_id="t4", transaction_date="2024-07-01 00:00:00"), dict(transaction_id="t5", account_id="zz"), dict(transaction_id="t6", account_id="a9"),
                              dict(transaction_id="t7", currency="EUR"), dict(transaction_id="t8", amount=9001.0), dict(transaction_id="t9", amount=9001.0, aml_flag=1))
    card = dict(card_id="k1", account_id="a1", card_number="4111111111111111", expiry_date="06/2024", cvv_hash="h", status="ACTIVE", credit_limit=1000.0)
    t["CARDS"] = table(spark, bank.SCHEMAS, "CARDS", card, dict(card_id="k2", expiry_date="05/2024"), dict(card_id="k3", card_number="4111111111111112"), dict(card_id="k4", cvv_hash=None),
                       dict(card_id="k5", credit_limit=1000.5), dict(card_id="k6", account_id=None))
    loan = dict(loan_id="l1", loan_type="MORTGAGE", collateral_value=100.0, ltv_ratio=80.0, next_payment_date="2024-06-15", interest_rate=5.0)
    t["LOANS"] = table(spark, bank.SCHEMAS, "LOANS", loan, dict(loan_id="l2", collateral_value=None), dict(loan_id="l3", loan_type="PERSONAL", collateral_value=None, ltv_ratio=None),
                       dict(loan_id="l4", ltv_ratio=None), dict(loan_id="l5", next_payment_date="2024-06-14"), dict(loan_id="l6", interest_rate=30.0))
    bene = dict(beneficiary_id="n1", customer_id="c1", full_name="X", account_number="1", routing_number="021000021", bic_swift="BNKUSABC", bank_country="US", verified=1)
    bene["bic_swift"] = "CITIUS33"
    t["BENEFICIARIES"] = table(spark, bank.SCHEMAS, "BENEFICIARIES", bene, dict(beneficiary_id="n2", full_name="Y", bic_swift=None, bank_country="DE", routing_number=None),
                               dict(beneficiary_id="n3", full_name="Z", bic_swift=None), dict(beneficiary_id="n4", full_name="W", verified=0), dict(beneficiary_id="n5", full_name="V", routing_number="0210000"),
                               dict(beneficiary_id="n6", full_name="U", customer_id="c4"), dict(beneficiary_id="n7"))
    ev = dict(event_id="r1", status="CLOSED", opened_date="2024-01-01 08:00:00", resolution_code="FALSE_POSITIVE", sar_filed=1, sar_filing_date="2024-01-31", risk_score=50.0,
              narrative=" ".join(["word"] * 12))
    t["RISK_EVENTS"] = table(spark, bank.SCHEMAS, "RISK_EVENTS", ev, dict(event_id="r2", sar_filing_date="2024-02-01"), dict(event_id="r3", sar_filing_date=None), dict(event_id="r4", status="OPEN"),
                             dict(event_id="r5", status="OPEN", opened_date="2024-05-16 00:00:00", sar_filed=0), dict(event_id="r6", narrative="Suspicious activity detected."),
                             dict(event_id="r7", risk_score=None), dict(event_id="r8", resolution_code=None))
    br = dict(branch_id="b1", address="12 North Main Street", country="US", manager_id="m", swift_bic=None, status="ACTIVE", license_expiry="2024-06-15")
    t["BRANCHES"] = table(spark, bank.SCHEMAS, "BRANCHES", br, dict(branch_id="b2", status="CLOSED"), dict(branch_id="b3", manager_id=None), dict(branch_id="b4", country="GB"),
                          dict(branch_id="b5", license_expiry="2024-06-14"), dict(branch_id="b6", address="99 Elm"))
    filings = t["BRANCHES"].select("branch_id", F.lit("12 N. Main St").alias("filed"))
    t = bank.prepare(t, filings)
    rules = bank.rules(t, AS_OF)
    got = {n: failing(t[n], rules[n], bank.KEYS[n]) for n in rules}
    assert got == {
        "CUSTOMERS": {"c1": {"duplicate_customers"}, "c5": {"duplicate_customers"}, "c2": {"missing_ssn", "kyc_completeness"}, "c3": {"invalid_email"},
                      "c4": {"address_incomplete", "kyc_completeness"}},
        "ACCOUNTS": {"a1": {"currency_mismatch"}, "a2": {"negative_balance"}, "a4": {"missing_rate"}, "a6": {"dormant_unflagged"}, "a9": {"missing_product_code"}, "a10": {"referential_integrity"}},
        "TRANSACTIONS": {"t2": {"suspicious_round"}, "t3": {"missing_merchant"}, "t4": {"future_dated"}, "t5": {"orphaned_txn", "closed_account"},
                         "t6": {"closed_account"}, "t8": {"large_flagged"}},
        "CARDS": {"k2": {"expired_active"}, "k3": {"invalid_luhn"}, "k4": {"missing_cvv_hash"}, "k5": {"overlapping_limits"}, "k6": {"unlinked_cards"}},
        "LOANS": {"l2": {"missing_collateral"}, "l4": {"missing_ltv"}, "l5": {"past_due_payment"}, "l6": {"rate_outlier"}},
        "BENEFICIARIES": {"n1": {"duplicate_bene"}, "n7": {"duplicate_bene"}, "n2": {"missing_bic"}, "n4": {"unverified"}, "n5": {"stale_routing"}, "n6": {"kyc_gap"}},
        "RISK_EVENTS": {"r2": {"sar_timeliness"}, "r3": {"missing_sar", "sar_timeliness"}, "r4": {"unresolved_alerts"}, "r6": {"incomplete_narrative"}, "r7": {"unscored"},
                        "r8": {"missing_resolution"}},
        "BRANCHES": {"b2": {"inactive_processing"}, "b3": {"missing_manager"}, "b4": {"missing_swift"}, "b5": {"license_expired"}, "b6": {"address_mismatch"}},
    }
    cov = {r["identifier"]: (r["present"], r["populated"]) for r in profile.coverage_summary(t["CARDS"], bank.PCI_COLUMNS).collect()}
    assert len(cov) == 10 and cov["Primary Account Number (PAN)"] == (True, 1.0) and cov["CVV / CVC / CID"][1] < 1 and cov["Token (surrogate PAN)"] == (False, 0.0)
    assert profile.coverage_summary(t["CUSTOMERS"], bank.KYC_COLUMNS).where("present").count() == 8


def test_core_rules(spark):
    t = {n: spark.createDataFrame([], s) for n, s in core.SCHEMAS.items()}
    cust = dict(customer_id="c1", email="a@b.org", phone="+1-212-555-0100", ssn="123-45-6789", credit_limit=1.0, updated_date="2024-01-01")
    t["CUSTOMERS"] = table(spark, core.SCHEMAS, "CUSTOMERS", cust, dict(customer_id="c2", email="aborg"), dict(customer_id="c3", ssn="INVALID-SSN"), dict(customer_id="c4", email=None),
                           dict(customer_id="c5", updated_date=None), dict(customer_id="c6", updated_date="2020-01-01"))
    o = dict(order_id="o1", customer_id="c1", amount=5.0, order_date="2024-01-01", ship_date="2024-01-02")
    t["ORDERS"] = table(spark, core.SCHEMAS, "ORDERS", o, dict(order_id="o2", customer_id="CUST-INVALID-7"), dict(order_id="o3", amount=-5.0), dict(order_id="o4", amount=None), dict(order_id="o5"),
                        dict(order_id="o5"), dict(order_id="o6", customer_id=None))
    t["EMPLOYEES"] = table(spark, core.SCHEMAS, "EMPLOYEES", dict(emp_id="1", email="a@b.org", ssn="123-45-6789", salary=1.0, manager_id=None), dict(emp_id="2", manager_id="1"), dict(emp_id="3", manager_id="99"))
    t["FINANCIALS"] = table(spark, core.SCHEMAS, "FINANCIALS", dict(txn_id="1", amount=1.0, currency="USD"), dict(txn_id="2", currency="INVALID"))
    rules = core.rules(t, AS_OF)
    got = {n: failing(t[n], rules[n], core.KEYS[n]) for n in rules}
    assert got == {
        "CUSTOMERS": {"c2": {"regex:email"}, "c3": {"regex:ssn"}, "c4": {"null_check:email"}, "c5": {"freshness:updated_date"}, "c6": {"freshness:updated_date"}},
        "ORDERS": {"o2": {"referential:customer_id"}, "o3": {"range:amount"}, "o4": {"null_check:amount"}, "o5": {"uniqueness:order_id"}},
        "EMPLOYEES": {"3": {"referential:manager_id"}}, "FINANCIALS": {"2": {"accepted:currency"}},
        "PRODUCTS": {}, "INVENTORY": {}, "CONTRACTS": {}, "RISK_EVENTS": {},
    }
    empty = R.run_rules(t["CONTRACTS"], "CONTRACTS", rules["CONTRACTS"]).collect()
    assert {(r["rows"], r["failed"], r["pass_rate"]) for r in empty} == {(0, 0, 0.0)}


def test_clinical_features(spark):
    pats = spark.createDataFrame([("p1", "1930-01-01", "Aetna"), ("p2", "2000-01-01", "Other")], "patient_id string, dob string, payer string")
    dx = spark.createDataFrame([("p1", "E11.9"), ("p1", "E11.9"), ("p1", "E11.65"), ("p1", "I50.9"), ("p2", "J06.9"), ("p2", None)], "patient_id string, icd10_code string")
    weights = spark.createDataFrame([("E11", "diabetes", 1, True), ("I50", "heart", 2, True), ("J0", "airways", 1, False)], "prefix string, grp string, weight int, chronic boolean")
    got = {tuple(r) for r in C.patient_features(pats, dx, weights, AS_OF, ["Medicare", "Aetna"]).collect()}
    assert got == {("p1", "90+", 2, 3, 2), ("p2", "20-29", 0, 1, 0)}
    enc = spark.createDataFrame([("e1", "p1", "v1", "470", "2024-01-01", "2024-01-05"), ("e2", "p1", "v1", "291", "2024-02-04", "2024-02-05"), ("e3", "p1", "v1", "470", "2024-03-07", None)],
                                "encounter_id string, patient_id string, provider_id string, drg_code string, admit string, discharge string")
    drg = spark.createDataFrame([("470", 2.0), ("291", 1.0)], "drg_code string, weight double")
    f = C.encounter_features(enc, "encounter_id", "patient_id", "admit", "discharge", drg)
    assert {(r["encounter_id"], r["los_days"], r["readmitted"]) for r in f.collect()} == {("e1", 4, True), ("e2", 1, False), ("e3", None, False)}
    prov = C.provider_features(f).first()
    assert (prov["encounters"], round(prov["case_mix_index"], 4), round(prov["readmission_rate"], 4)) == (3, 1.6667, 0.3333)


def test_medication_lab_claim_features(spark):
    med = [("m%d" % i, "p1", "drug%d" % i, "n%d" % i, "ACTIVE", "2024-01-01", "2024-01-10") for i in range(5)]
    med += [("m9", "p2", "drug1", "n1", "ACTIVE", "2024-01-01", "2024-01-10"), ("m10", "p2", "drug1", "n1", "COMPLETED", "2024-01-05", "2024-01-12"), ("m11", "p2", "drug1", "n1", "ACTIVE", "2024-01-17", "2024-01-20")]
    meds = spark.createDataFrame(med, "medication_id string, patient_id string, drug_name string, ndc_code string, status string, start_date string, end_date string")
    got = {r["patient_id"]: (r["active_drugs"], r["polypharmacy"], r["high_risk"], r["adherence"]) for r in
           C.medication_features(meds, spark.createDataFrame([("n4",)], "ndc_code string")).collect()}
    assert got == {"p1": (5, True, True, 1.0), "p2": (1, False, False, 0.8)}
    # the same cover when the patient is split as a hot key
    from assay.operators.ordered import hot_keys
    flat = meds.select("patient_id", F.unix_date(F.col("start_date").cast("date")).alias("__s"), F.col("medication_id").alias("__id"))
    cover = lambda hot: {tuple(r) for r in C.covered_days(meds, ["patient_id"], "start_date", "end_date", "medication_id", hot).collect()}
    assert cover(hot_keys(flat, ["patient_id"], ["__s", "__id"], 1)) == cover(None)
    labs = spark.createDataFrame([("p1", "x", "2024-01-%02d" % d, float(v), 10.0, 20.0, 30.0) for d, v in ((1, 10), (2, 12), (3, 14), (9, 31))],
                                 "patient_id string, loinc_code string, collection_date string, result_value double, reference_low double, reference_high double, critical_high double")
    results, trend = C.lab_features(labs)
    assert [(r["flag"], r["z_score"]) for r in results.orderBy("collection_date").collect()] == [("N", -2.0), ("N", -1.2), ("N", -0.4), ("C", 6.4)]
    assert [r["slope"] for r in trend.orderBy("day").collect()] == [None, 2.0, 2.0, (31 - 14) / 6.0]
    assert tuple(C.abnormal_counts(results).first()) == ("p1", 1, 1)
    claims = spark.createDataFrame([("A", "e1", 10.0, "PAID"), ("A", "e1", 5.0, "DENIED"), ("A", "e2", 5.0, "PAID"), ("B", "e3", 1.0, "PAID")],
                                   "payer string, encounter_id string, paid_amount double, claim_status string")
    assert {(r["payer"], r["claims"], round(r["denial_rate"], 3), r["cost_per_encounter"]) for r in C.claim_features(claims).collect()} == {("A", 3, 0.333, 10.0), ("B", 1, 0.0, 1.0)}
    proc = spark.createDataFrame([("47562", 130), ("99213", 10), ("G0463", 600)], "cpt_code string, duration_minutes int")
    assert [(r["category"], r["complexity"]) for r in C.procedure_features(proc, [("10000", "69999", "SURGERY"), ("99202", "99499", "VISIT")]).collect()] == [
        ("SURGERY", 3), ("VISIT", 1), ("OTHER", 5)]


def test_banking_features(spark):
    cust = spark.createDataFrame([("c1", "s", "d", 0), ("c2", None, None, 0), ("c3", "s", "d", 1)], "customer_id string, ssn string, dob string, pep_flag int")
    acc = spark.createDataFrame([("a1", "c1", "b1", "2023-06-16", 100.0), ("a2", "c1", "b1", "2024-01-01", 50.0), ("a3", "c2", "b2", "2024-06-14", 10.0)],
                                "account_id string, customer_id string, branch_id string, opened_date string, balance double")
    hits = spark.createDataFrame([("c9",)], "customer_id string")
    got = {tuple(r) for r in B.customer_risk(cust, acc, hits, ["ssn", "dob"], AS_OF).collect()}
    assert got == {("c1", 100, False, 0, 2, 365, "LOW"), ("c2", 0, False, 0, 1, 1, "MEDIUM"), ("c3", 100, True, 0, 0, None, "HIGH")}
    loans = spark.createDataFrame([("a1", 300.0), ("a1", 75.0)], "account_id string, outstanding_balance double")
    assert {(r["branch_id"], r["deposit_to_loan"]) for r in B.branch_features(acc, loans).collect()} == {("b1", 0.4), ("b2", None)}
    book = spark.createDataFrame([("S", 100.0), ("S", 5000.0), ("T", 1.0)], "seg string, ead double")
    params = spark.createDataFrame([("S", 0.0, 1000.0, 0.1, 0.5, "base"), ("S", 1000.0, 1e9, 0.02, 0.5, "base"), ("S", 0.0, 1000.0, 0.2, 0.5, "stress"), ("S", 1000.0, 1e9, 0.04, 0.5, "stress")],
                                   "seg string, lo double, hi double, pd double, lgd double, scenario string")
    res = {(r["seg"], r["scenario"]): r["reserve"] for r in B.reserve(B.expected_loss(book, params, "seg", "ead", "scenario"), ["seg", "scenario"]).collect()}
    assert {k: (None if v is None else float(v)) for k, v in res.items()} == {("S", "base"): 55.0, ("S", "stress"): 110.0, ("T", None): None}
    dep = spark.createDataFrame([("c1", "single", 200000.0), ("c1", "single", 100000.0), ("c1", "joint", -5.0)], "c string, cat string, bal double")
    assert {(r["cat"], float(r["insured"]), float(r["uninsured"])) for r in B.insured(dep, ["c", "cat"], "bal").collect()} == {("single", 250000.0, 50000.0), ("joint", 0.0, 0.0)}
    assert [r["dscr"] for r in B.dscr(spark.createDataFrame([(150.0, 100.0), (1.0, 0.0)], "i double, d double"), "i", "d").collect()] == [1.5, None]
    uses = spark.createDataFrame([("k", dt.datetime(2024, 1, 1, 0), 1, 40.7, -74.0), ("k", dt.datetime(2024, 1, 1, 1), 2, 51.5, -0.1), ("k", dt.datetime(2024, 1, 2, 1), 3, 51.5, -0.2)],
                                 "card string, ts timestamp, id int, lat double, lon double")
    assert [r["anomaly"] for r in B.travel_anomaly(uses, "card", ["ts", "id"], "lat", "lon", 900).orderBy("id").collect()] == [False, True, False]
    alerts = spark.createDataFrame([("R", "FALSE_POSITIVE", 20), ("R", "TRUE_POSITIVE", 5), ("R", None, 5), ("M", None, 20)], "src string, resolution_code string, words int")
    assert {(r["src"], r["false_positive_rate"], round(r["narrative_rate"], 2)) for r in
            B.alert_features(alerts, "src", F.col("resolution_code") == "FALSE_POSITIVE", F.col("words") >= 12).collect()} == {("R", 0.5, 0.33), ("M", 0.0, 1.0)}
    benes = spark.createDataFrame([("n1", "c1", "X1", "IR", 1), ("n2", "c2", "X1", "US", 0)], "beneficiary_id string, customer_id string, account_number string, bank_country string, verified int")
    near = spark.createDataFrame([("n1", 2), ("n1", 1)], "beneficiary_id string, distance int")
    assert {tuple(r) for r in B.bene_features(benes, ["IR"], near).collect()} == {("n1", True, True, 1, 2), ("n2", False, False, None, 2)}
