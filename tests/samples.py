"""Sample clinical code lists for the tests; real lists come from the caller."""

# Code lists of the clinical tables. ICD-10-CM:
ICD10 = ["E11.9", "I10", "J18.9", "K21.0", "M54.5", "F32.9", "N18.3", "J44.1", "I25.10", "E78.5", "J06.9", "G43.909", "A09", "Z87.891",
         "F41.9", "I48.91", "E03.9", "K57.30", "M17.11", "J45.20", "N39.0", "Z79.4", "I50.9", "C34.10", "S72.001A"]
# CPT and HCPCS:
CPT = ["99213", "99214", "99215", "99232", "99233", "71046", "71045", "93000", "93010", "80053", "80061", "85025", "85027", "36415", "99285",
       "99291", "99292", "43239", "47562", "27447", "90715", "90686", "G0463", "99203", "99204"]
# LOINC with low, high and critical bound:
LOINC = [("2093-3", 100, 200, 240), ("2571-8", 50, 150, 500), ("718-7", 11.0, 17.5, 20.0), ("4548-4", 4.0, 6.5, 15.0), ("2160-0", 0.5, 1.2, 15.0),
         ("1742-6", 7, 56, 3000), ("1920-8", 10, 40, 5000), ("777-3", 150, 400, 1500), ("26464-8", 4.0, 11.0, 100), ("14682-9", 135, 145, 180),
         ("2823-3", 3.5, 5.0, 8.0), ("33037-3", 60, 100, 600), ("3094-0", 7, 20, 150), ("6768-6", 44, 147, 1000), ("49765-1", 8.5, 10.5, 14.0)]
# NDC with standard dose:
NDC = [("00074-3799-13", 500), ("00069-0150-30", 10), ("59762-0001-01", 20), ("00003-0892-20", 5), ("00085-1328-01", 20), ("57894-0015-30", 50),
       ("00071-0155-24", 50), ("00378-5074-91", 300), ("00093-7149-56", 2), ("00069-0031-68", 20), ("00006-0963-54", 5), ("50458-0579-30", 5),
       ("00093-0058-01", 25), ("00069-0172-66", 250), ("16590-0618-30", 500)]


def tables(spark):
    """(valid codes by column, standard doses, critical bounds)"""
    one = lambda values: spark.createDataFrame([(v,) for v in values], "code string")
    codes = {"icd10_code": one(ICD10), "cpt_code": one(CPT), "loinc_code": one([x[0] for x in LOINC]), "ndc_code": one([c for c, _ in NDC])}
    doses = spark.createDataFrame([(c, float(d)) for c, d in NDC], "ndc_code string, standard_dose double")
    bounds = spark.createDataFrame([(c, float(d)) for c, _, _, d in LOINC], "loinc_code string, critical_high double")
    return codes, doses, bounds
