"""The 18 identifier categories of the Safe Harbor method: found in all columns of a table, summed up over tables, and treated.

A category is found in a column by the column's name, by its type, or by its values. All columns and categories of a table are judged in one pass; values
are looked at in text columns, and only where they are long enough and a cheap test for a character that every match has lets them through. Each category has a
treatment for a column that is known by its name or type; a text in which values were found among others is scrubbed of them instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from assay.functions import patterns
from assay.operators import deid

START = "(^|[^A-Za-z0-9])"


@dataclass(frozen=True)
class Category:
    """``name`` and ``value`` are patterns; ``types`` are types that tell the category by themselves; ``needle`` is a text that every match has ("" for a digit),
    ``least`` the bytes that the shortest match takes."""
    name: str
    value: str | None
    treatment: str
    types: tuple = ()
    needle: str = ""
    least: int = 0


_RULES = [
    Category(r"(?i)(^|_)name$|(first|last|middle|maiden|full)_?name", START + r"(Mr|Mrs|Ms|Dr)\. [A-Z][a-z]+", "hash", needle=". ", least=6),
    Category(r"(?i)address|street|(^|_)city$|county|(^|_)zip|postal", START + r"[0-9]{1,5} [A-Z][a-z]+ (St|Ave|Rd|Blvd|Ln|Street|Avenue|Road|Boulevard|Lane|Drive)([^a-z]|$)", "zip3", least=7),
    Category(r"(?i)date|^dob$|birth|(^|_)ts$", r"(^|[^0-9])(19|20)[0-9]{2}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])([^0-9]|$)", "year",
             (T.DateType, T.TimestampType, T.TimestampNTZType), "-", 10),
    Category(r"(?i)phone|mobile|(^|_)tel$", patterns.PHONE, "drop", least=12),
    Category(r"(?i)(^|_)fax", r"[Ff][Aa][Xx][:. ]+" + patterns.PHONE, "drop", least=16),
    Category(r"(?i)e_?mail", patterns.EMAIL, "drop", needle="@", least=6),
    Category(r"(?i)(^|_)ssn|social_sec", START + patterns.SSN + r"([^0-9]|$)", "drop", needle="-", least=11),
    Category(r"(?i)(^|_)mrn|medical_record", START + r"MRN[-:# ]*[0-9]{5,}", "hash", needle="MRN", least=8),
    Category(r"(?i)member_id|beneficiary_(id|no)|plan_(id|no)|medicare|medicaid", r"[Mm]ember (ID|id|No|no)[.:# ]*[A-Z0-9]{6,}", "hash", needle="ember ", least=15),
    Category(r"(?i)account_?(id|no|num)|acct_?(id|no|num)|(^|_)iban|card_?(no|num)|^pan$", patterns.CARD, "hash", least=16),
    Category(r"(?i)licen[cs]e_?(id|no|num)|certificate|(^|_)(dea|npi)(_|$)", r"[Ll]icen[cs]e (No|no|number)[.:# ]*[A-Z0-9-]{5,}", "drop", needle="icen", least=15),
    Category(r"(?i)(^|_)vin$|licen[cs]e_plate|(^|_)plate", START + r"VIN[:# ]*[A-HJ-NPR-Z0-9]{17}([^A-Z0-9]|$)", "drop", needle="VIN", least=20),
    Category(r"(?i)device|serial|(^|_)imei|(^|_)udi$|mac_addr", START + r"([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}([^0-9A-Fa-f:]|$)", "drop", needle=":", least=17),
    Category(r"(?i)(^|_)url$|website|homepage", patterns.URL, "drop", needle="://", least=8),
    Category(r"(?i)(^|_)ip(_|$)", patterns.IP, "drop", needle=".", least=7),
    Category(r"(?i)biometric|fingerprint|retina|voice_?print|embedding", None, "drop"),
    Category(r"(?i)photo|portrait|(^|_)(image|face)$|thumbnail", r"data:image/[a-z]+;base64,", "drop", (T.BinaryType,), "data:image", 20),
    Category(r"(?i)(^|_)(id|uuid|guid|key)$|[a-z]key$", START + r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}([^0-9a-f]|$)", "hash", needle="-", least=36),
]
#: By the names of the categories, in their order.
RULES: dict[str, Category] = dict(zip(deid.SAFE_HARBOR, _RULES, strict=True))


def identifier_flags(df: DataFrame, table: str, rules: dict[str, Category] | None = None, min_rate: float = 0.0) -> DataFrame:
    """One line per column and category: ``table_name, column_name, identifier, by_name, by_type, hits, filled, found``.

    A category is found by name, by type, or if more than ``min_rate`` of the column's values hold it.
    """
    rules = rules or RULES
    fields = df.schema.fields
    texts = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)]
    # Whether a value has a digit is looked up once for all categories, and only in values long enough for one of them.
    short = min([r.least for r in rules.values() if r.value is not None and not r.needle], default=0)
    digits = [F.coalesce((F.octet_length(F.col(f"`{fields[i].name}`")) >= short) & F.col(f"`{fields[i].name}`").rlike("[0-9]"), F.lit(False)).alias(f"__d{i}") for i in texts]
    looked = df.select("*", *digits)
    aggs = [F.count(F.col(f"`{f.name}`")).alias(f"n{i}") for i, f in enumerate(fields)]
    for i in texts:
        c = F.col(f"`{fields[i].name}`")
        for k, r in enumerate(rules.values()):
            if r.value is not None:
                may = c.contains(r.needle) if r.needle else F.col(f"__d{i}")
                aggs.append(F.count_if((F.octet_length(c) >= r.least) & may & c.rlike(r.value)).alias(f"h{i}_{k}"))
    cells = [F.struct(
        F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(name).alias("identifier"), F.lit(f.name).rlike(r.name).alias("by_name"),
        F.lit(isinstance(f.dataType, r.types) if r.types else False).alias("by_type"),
        (F.col(f"h{i}_{k}") if i in texts and r.value is not None else F.lit(0).cast("long")).alias("hits"), F.col(f"n{i}").alias("filled"))
        for i, f in enumerate(fields) for k, (name, r) in enumerate(rules.items())]
    lines = looked.agg(*aggs).select(F.inline(F.array(*cells)))
    return lines.withColumn("found", F.col("by_name") | F.col("by_type") | (F.col("hits") > F.col("filled") * F.lit(min_rate)))


def treatments(flags: DataFrame, rules: dict[str, Category] | None = None) -> dict[str, str]:
    """What to do with each column of one table in which a category was found: the strictest treatment by name or type, else scrub the text.

    As many lines as the table has columns come to the driver.
    """
    rules = rules or RULES
    strict = ["drop", "hash", "zip3", "year"]  # what leaves least comes first
    out: dict[str, str] = {}
    for r in flags.where("found").orderBy("column_name").collect():
        if r.by_name or r.by_type:
            kind = rules[r.identifier].treatment
            before = out.get(r.column_name)
            out[r.column_name] = kind if before not in strict or strict.index(kind) < strict.index(before) else before
        else:
            out.setdefault(r.column_name, "text")
    return out


def deidentified(df: DataFrame, table: str, key: str, small_zip3: list[str] | None = None, rules: dict[str, Category] | None = None, min_rate: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(the table with every identifier treated, its flags)."""
    flags = identifier_flags(df, table, rules, min_rate)
    return deid.safe_harbor(df, treatments(flags, rules), key, small_zip3), flags
