"""De-identification: tokens, masking by category, date shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assay.functions import columns as fx, patterns


def token_key(spark, name: str = "assay.token.key") -> str:
    """The tokenisation key from the session; it appears neither in code nor in any output."""
    key = spark.conf.get(name, None)
    if not key:
        raise ValueError(f"set {name} before tokenising")
    return key


def tokenise(df: DataFrame, col: str, key: str, keep: int = 4) -> tuple[DataFrame, DataFrame]:
    """(table with token and last characters in place of the value, vault of token and value hash).

    The vault has one line per distinct value and is meant to be stored apart from the data.
    """
    tok = fx.token(col, key)
    out = df.withColumns({f"{col}_token": tok, f"{col}_last{keep}": F.right(F.col(col), F.lit(keep))}).drop(col)
    vault = df.where(F.col(col).isNotNull()).select(
        tok.alias("token"), F.sha2(F.col(col).cast("string"), 256).alias("value_hash")).distinct()
    return out, vault


# The 18 identifier categories of the Safe Harbor method.
SAFE_HARBOR = [
    "Names", "Geographic data (sub-state)", "Dates (except year)", "Phone numbers", "Fax numbers",
    "Email addresses", "Social Security Numbers", "Medical Record Numbers", "Health plan beneficiary numbers",
    "Account numbers", "Certificate/license numbers", "Vehicle identifiers", "Device identifiers", "URLs",
    "IP addresses", "Biometric identifiers", "Full-face photographs", "Any unique identifying number",
]

# Pattern, its replacement, and a text every match contains ("" stands for a digit).
FREE_TEXT = [
    (patterns.EMAIL, "[email]", "@"), (patterns.URL, "[url]", "://"), (patterns.SSN, "[ssn]", ""),
    (patterns.CARD, "[card]", ""), (patterns.PHONE, "[phone]", ""), (patterns.IP, "[ip]", ""),
]


def scrub_text(df: DataFrame, col: str) -> DataFrame:
    """Replace every e-mail, URL, SSN, card, phone and IP value in free text, the whole text through.

    A cheap test for a character every match must have spares most texts the pattern. One step per
    pattern, each in its own projection, so that no step is evaluated twice.
    """
    for pattern, mark, needle in FREE_TEXT:
        may = F.col(col).contains(needle) if needle else F.col(col).rlike("[0-9]")
        df = df.withColumn(col, F.when(may, F.regexp_replace(col, pattern, mark)).otherwise(F.col(col)))
    return df


def safe_harbor(df: DataFrame, tags: dict[str, str], key: str = "", small_zip3: list[str] | None = None) -> DataFrame:
    """Apply one treatment per column: drop, null, mask, hash, year, zip3, text."""
    actions = {
        "null": lambda c: F.lit(None).cast(df.schema[c].dataType),
        "mask": lambda c: F.mask(F.col(c).cast("string")),
        "hash": lambda c: fx.token(c, key),
        "year": lambda c: F.year(F.col(c).cast("date")),
        "zip3": lambda c: fx.zip3(c, small_zip3 or []),
    }
    out = df.withColumns({c: actions[t](c) for c, t in tags.items() if t in actions})
    for c in [c for c, t in tags.items() if t == "text"]:
        out = scrub_text(out, c)
    return out.drop(*[c for c, t in tags.items() if t == "drop"])


def shift_dates(df: DataFrame, cols: list[str], offset: Column) -> DataFrame:
    """Move dates by a per-subject number of days; intervals within a subject are preserved."""
    return df.withColumns({c: F.date_add(F.col(c).cast("date"), offset) for c in cols})


def rare_to_year(df: DataFrame, condition: str, date_cols: list[str], n: int) -> DataFrame:
    """Keep only the year of dates on rows whose condition occurs fewer than ``n`` times.

    Only the rare conditions are joined back, so frequent ones, however hot, pass through unmatched.
    """
    rare = df.groupBy(condition).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") < n).select(
        F.col(condition).alias("__rare"))
    joined = df.join(rare, F.col(condition) == F.col("__rare"), "left")
    return joined.withColumns({
        c: F.when(F.col("__rare").isNotNull(), F.trunc(F.col(c).cast("date"), "year")).otherwise(F.col(c).cast("date")) for c in date_cols
    }).drop("__rare")
