"""Clinical feature tables. Weights, doses and drug lists come from the caller; none poses as authoritative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assay.functions import columns as fx
from assay.operators.ordered import AUTO, neighbour, rolling, running
from assay.operators.rules import lab_flag


def patient_features(patients: DataFrame, diagnoses: DataFrame, weights: DataFrame, as_of: str,
                     payers: list[str] | None = None) -> DataFrame:
    """Age band, number of chronic groups, comorbidity index and payer code per patient.

    ``weights``: (prefix, grp, weight, chronic). A code belongs to a group when it starts with the prefix;
    its prefixes are joined by equality. Each group counts once per patient.
    """
    coded = diagnoses.select("patient_id", F.regexp_replace("icd10_code", "[.]", "").alias("code")).distinct()
    prefixes = coded.where(F.length("code") > 0).select("patient_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("code")), lambda i: F.substring("code", F.lit(1), i))).alias("prefix"))
    groups = prefixes.join(weights, "prefix").groupBy("patient_id", "grp").agg(
        F.max("weight").alias("weight"), F.bool_or("chronic").alias("chronic"))
    index = groups.groupBy("patient_id").agg(F.count_if("chronic").alias("chronic_count"), F.sum("weight").alias("comorbidity_index"))
    out = patients.join(index, "patient_id", "left").withColumns({
        "age_band": fx.age_band("dob", as_of), "chronic_count": F.coalesce("chronic_count", F.lit(0)),
        "comorbidity_index": F.coalesce("comorbidity_index", F.lit(0)),
    })
    cols = ["patient_id", "age_band", "chronic_count", "comorbidity_index"]
    if payers:
        out = out.withColumn("payer_code", F.coalesce(F.array_position(F.array(*map(F.lit, payers)), F.col("payer")), F.lit(0)).cast("int"))
        cols.append("payer_code")
    return out.select(*cols)


def encounter_features(enc: DataFrame, key: str, patient: str, admit: str, discharge: str, drg: DataFrame | None = None,
                       days: int = 30, hot=AUTO) -> DataFrame:
    """Length of stay, whether the patient is admitted again within ``days`` of discharge, DRG weight."""
    ahead = neighbour(enc, [patient], [admit, key], {"next_admit": (admit, 1)}, following=True, hot=hot)
    gap = F.datediff(F.col("next_admit").cast("date"), F.col(discharge).cast("date"))
    out = ahead.withColumns({
        "los_days": F.datediff(F.col(discharge).cast("date"), F.col(admit).cast("date")),
        "readmitted": F.coalesce(gap.between(0, days), F.lit(False)),
    })
    return out.join(drg, "drg_code", "left") if drg is not None else out


def covered_days(df: DataFrame, keys: list[str], start: str, end: str, id: str, hot=AUTO) -> DataFrame:
    """Days covered by the union of possibly overlapping intervals, and the span they lie in.

    Each interval adds only the days after the latest end seen before it, so no day list is built.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    flat = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))).select(
        *keys, F.col(id).alias("__id"), day(start).alias("__s"), day(end).alias("__e"))
    ends = running(flat, keys, ["__s", "__id"], {"__seen": F.col("__e")}, how="max", inclusive=False, hot=hot)
    added = F.greatest(F.col("__e") - F.greatest(F.col("__s") - 1, F.coalesce("__seen", F.col("__s") - 1)), F.lit(0))
    return ends.groupBy(*keys).agg(
        F.sum(added).alias("days_covered"), (F.max("__e") - F.min("__s") + 1).alias("period_days"), F.count(F.lit(1)).alias("intervals"))


def medication_features(meds: DataFrame, high_risk: DataFrame, poly: int = 5, hot=AUTO) -> DataFrame:
    """Active drugs, polypharmacy, high-risk drug flag and adherence (days covered over period) per patient."""
    active = meds.where(F.col("status") == "ACTIVE").groupBy("patient_id", "drug_name").agg(F.lit(1).alias("one")).groupBy(
        "patient_id").agg(F.count(F.lit(1)).alias("active_drugs"))
    risky = meds.join(high_risk.select("ndc_code").distinct(), "ndc_code", "left_semi").groupBy("patient_id").agg(F.lit(True).alias("high_risk"))
    cover = covered_days(meds, ["patient_id"], "start_date", "end_date", "medication_id", hot)
    return (
        meds.select("patient_id").distinct().join(active, "patient_id", "left").join(risky, "patient_id", "left").join(cover, "patient_id", "left")
        .select("patient_id", F.coalesce("active_drugs", F.lit(0)).alias("active_drugs"),
                (F.coalesce("active_drugs", F.lit(0)) >= poly).alias("polypharmacy"),
                F.coalesce("high_risk", F.lit(False)).alias("high_risk"),
                F.round(F.col("days_covered") / F.col("period_days"), 4).alias("adherence")))


def trend(df: DataFrame, key: list[str], ts: str, value: str, days: int = 7, scale: int = 6) -> DataFrame:
    """Least-squares slope per day over the trailing days, from trailing sums; null below two distinct days.

    Rows without a value are left out. Values may have ``scale`` digits after the point, six at most.
    """
    df = df.where(F.col(value).isNotNull())
    x = F.unix_date(F.col(ts).cast("date")).cast("decimal(18,0)")
    y = fx.exact(df, value, scale).cast(f"decimal(28,{scale})")
    label = f"{days}d"
    sums = rolling(df, key, ts, {"n": F.lit(1).cast("long"), "x": x, "y": y, "xx": (x * x).cast("decimal(24,0)"),
                                 "xy": (x.cast("decimal(9,0)") * y).cast(f"decimal(38,{scale})")}, {label: days}, "day")
    c = lambda m: F.col(f"{m}_{label}")
    above = (c("n") * c("xy") - c("x") * c("y")).cast("double")
    below = (c("n") * c("xx") - c("x") * c("x")).cast("double")
    return sums.select(*key, F.date_from_unix_date(F.col("tick").cast("int")).alias("day"), c("n").alias("n"),
                       F.when(below != 0, above / below).alias("slope"))


def lab_features(labs: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(per result: flag, critical alert, z-score against the reference interval; per patient and test: slope)."""
    mid = (F.col("reference_low") + F.col("reference_high")) / 2
    critical = F.col("critical_high") if "critical_high" in labs.columns else 3 * F.col("reference_high")
    flag = lab_flag(F.col("result_value"), F.col("reference_low"), F.col("reference_high"), critical)
    results = labs.withColumns({
        "flag": flag, "critical_alert": flag == "C",
        "z_score": F.round((F.col("result_value") - mid) / ((F.col("reference_high") - F.col("reference_low")) / 4), 4)})
    return results, trend(labs, ["patient_id", "loinc_code"], "collection_date", "result_value", days)


def abnormal_counts(results: DataFrame, by: str = "patient_id") -> DataFrame:
    return results.groupBy(by).agg(F.count_if(F.col("flag") != "N").alias("abnormal"), F.count_if("critical_alert").alias("critical"))


def procedure_features(proc: DataFrame, ranges: list[tuple[str, str, str]]) -> DataFrame:
    """CPT category from the code range it falls into, and long-procedure flag; ranges: (low, high, name)."""
    category = F.lit("OTHER")
    for low, high, name in ranges:
        category = F.when(F.col("cpt_code").between(low, high), name).otherwise(category)
    return proc.withColumns({"category": category, "complexity": F.least(F.floor(F.col("duration_minutes") / 60) + 1, F.lit(5))})


def rate_features(df: DataFrame, by: list[str], rates: dict[str, Column], amount: str | None = None, scale: int | None = None) -> DataFrame:
    """Rows, shares of true conditions and average amount per group: denial, readmission, payer mix and the like."""
    aggs = [F.count(F.lit(1)).alias("rows")] + [(F.count_if(c) / F.count(F.lit(1))).alias(n) for n, c in rates.items()]
    if amount:
        aggs.append((F.sum(fx.exact(df, amount, scale)).cast("double") / F.count(amount)).alias("avg_amount"))
    return df.groupBy(*by).agg(*aggs)


def mix(df: DataFrame, by: str, col: str, values: list[str]) -> DataFrame:
    """Share of each listed value per group, as columns."""
    n = F.count(F.lit(1))
    return df.groupBy(by).agg(*[(F.count_if(F.col(col) == v) / n).alias(f"share_{v}") for v in values])


def claim_features(claims: DataFrame, scale: int | None = None) -> DataFrame:
    """Denial rate and cost per encounter by payer."""
    per = claims.groupBy("payer", "encounter_id").agg(
        F.sum(fx.exact(claims, "paid_amount", scale)).alias("cost"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("claim_status") == "DENIED").alias("denied"))
    return per.groupBy("payer").agg(
        F.sum("n").alias("claims"), (F.sum("denied") / F.sum("n")).alias("denial_rate"),
        (F.sum("cost").cast("double") / F.count(F.lit(1))).alias("cost_per_encounter"))


def provider_features(enc: DataFrame, weight: str = "weight") -> DataFrame:
    """Case-mix index (mean DRG weight) and readmission rate per provider, from encounter features."""
    return enc.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("encounters"), F.avg(weight).alias("case_mix_index"),
        (F.count_if("readmitted") / F.count(F.lit(1))).alias("readmission_rate"))
