"""Target tables and resource-shaped projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def create_layer_tables(spark: SparkSession, schemas: dict[str, StructType], layer: str, partition_by: dict[str, str] | None = None,
                        sensitive: dict[str, list[str]] | None = None) -> list[str]:
    """Create the tables of a layer from measured schemas; sensitive columns carry a comment."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{layer}`")
    made = []
    for table, schema in schemas.items():
        marked = (sensitive or {}).get(table, [])
        cols = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" + (" COMMENT 'sensitive'" if f.name in marked else "") for f in schema.fields)
        part = (partition_by or {}).get(table)
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{layer}`.`{table}` ({cols}) USING parquet"
                  + (f" PARTITIONED BY (`{part}`)" if part else "") + f" COMMENT '{layer} layer'")
        made.append(f"{layer}.{table}")
    return made


# Resource of each clinical table.
FHIR_RESOURCES = {
    "PATIENTS": "Patient", "ENCOUNTERS": "Encounter", "DIAGNOSES": "Condition", "MEDICATIONS": "MedicationRequest",
    "LAB_RESULTS": "Observation", "PROCEDURES": "Procedure", "CLAIMS": "Claim", "PROVIDERS": "Practitioner",
}


def _ref(kind: str, col: str):
    return F.struct(F.concat(F.lit(f"{kind}/"), F.col(col)).alias("reference"))


def _code(system: str, col: str, text: str | None = None):
    coding = F.array(F.struct(F.lit(system).alias("system"), F.col(col).alias("code")))
    return F.struct(coding.alias("coding"), *([F.col(text).alias("text")] if text else []))


def _period(start: str, end: str):
    return F.struct(F.col(start).alias("start"), F.col(end).alias("end"))


def _resource(table: str) -> list:
    """Fields of a resource; each maps one clinical table."""
    name = F.array(F.struct(F.col("last_name").alias("family"), F.array("first_name").alias("given"))).alias("name") \
        if table in ("PATIENTS", "PROVIDERS") else None
    return {
        "PATIENTS": lambda: [
            F.col("patient_id").alias("id"), F.array(F.struct(F.lit("MR").alias("type"), F.col("mrn").alias("value"))).alias("identifier"), name,
            F.when(F.col("gender") == "M", "male").when(F.col("gender") == "F", "female").otherwise("unknown").alias("gender"),
            F.col("dob").alias("birthDate"),
            F.array_compact(F.array(F.when(F.col("phone").isNotNull(), F.struct(F.lit("phone").alias("system"), F.col("phone").alias("value"))),
                                    F.when(F.col("email").isNotNull(), F.struct(F.lit("email").alias("system"), F.col("email").alias("value"))))).alias("telecom"),
            F.array(F.struct(F.array("address").alias("line"), "city", "state", F.col("zip").alias("postalCode"))).alias("address")],
        "PROVIDERS": lambda: [
            F.col("provider_id").alias("id"), F.array(F.struct(F.lit("NPI").alias("type"), F.col("npi").alias("value"))).alias("identifier"), name,
            F.struct(F.col("specialty").alias("text")).alias("qualification"), (F.col("status") == "ACTIVE").alias("active")],
        "ENCOUNTERS": lambda: [
            F.col("encounter_id").alias("id"), F.lower("status").alias("status"), F.col("encounter_type").alias("class"),
            _ref("Patient", "patient_id").alias("subject"), _period("admit_date", "discharge_date").alias("period")],
        "DIAGNOSES": lambda: [
            F.col("diagnosis_id").alias("id"), _code("ICD-10-CM", "icd10_code", "icd10_description").alias("code"),
            _ref("Patient", "patient_id").alias("subject"), _ref("Encounter", "encounter_id").alias("encounter"),
            F.col("onset_date").alias("onsetDateTime"), F.col("resolution_date").alias("abatementDateTime")],
        "MEDICATIONS": lambda: [
            F.col("medication_id").alias("id"), F.lower("status").alias("status"), _code("NDC", "ndc_code", "drug_name").alias("medication"),
            _ref("Patient", "patient_id").alias("subject"),
            F.array(F.struct(F.struct(F.col("dose").try_cast("double").alias("value"), F.col("dose_unit").alias("unit")).alias("dose"),
                             F.col("route").alias("route"), F.col("frequency").alias("timing"))).alias("dosageInstruction")],
        "LAB_RESULTS": lambda: [
            F.col("lab_id").alias("id"), F.lower("status").alias("status"), _code("LOINC", "loinc_code", "test_name").alias("code"),
            _ref("Patient", "patient_id").alias("subject"), F.struct(F.col("result_value").alias("value"), F.col("result_unit").alias("unit")).alias("valueQuantity"),
            F.array(F.struct(F.col("reference_low").alias("low"), F.col("reference_high").alias("high"))).alias("referenceRange"),
            F.col("collection_date").alias("effectiveDateTime"), F.col("result_date").alias("issued")],
        "PROCEDURES": lambda: [
            F.col("procedure_id").alias("id"), F.lower("status").alias("status"), _code("CPT", "cpt_code", "procedure_name").alias("code"),
            _ref("Patient", "patient_id").alias("subject"), _ref("Encounter", "encounter_id").alias("encounter"), F.col("procedure_date").alias("performedDateTime")],
        "CLAIMS": lambda: [
            F.col("claim_id").alias("id"), F.lower("claim_status").alias("status"), F.lower("claim_type").alias("type"),
            _ref("Patient", "patient_id").alias("patient"), _ref("Practitioner", "provider_id").alias("provider"),
            F.col("claim_date").alias("created"), F.struct(F.col("billed_amount").alias("value"), F.lit("USD").alias("currency")).alias("total")],
    }[table]()


def to_fhir(df: DataFrame, table: str) -> DataFrame:
    """(id, resource struct) for one of the eight clinical tables; ``to_json`` makes it a document."""
    return df.select(F.struct(F.lit(FHIR_RESOURCES[table]).alias("resourceType"), *_resource(table)).alias("resource")).select(
        F.col("resource.id").alias("id"), "resource")


def to_resource(df: DataFrame, kind: str, id: str, fields: dict) -> DataFrame:
    """General form: any table to (id, JSON document) with the given fields."""
    return df.select(F.col(id).alias("id"), F.to_json(F.struct(F.lit(kind).alias("resourceType"), *[e.alias(n) for n, e in fields.items()])).alias("document"))
