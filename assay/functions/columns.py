"""Column expressions for cleansing and validity. All run inside generated code, none in Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assay.functions import patterns


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# -- cleansing ---------------------------------------------------------------------------------------

def clean_email(col: Column | str) -> Column:
    """Trimmed, lower-case address."""
    return F.lower(F.trim(_c(col)))


def valid_email(col: Column | str) -> Column:
    return _c(col).rlike(patterns.EMAIL_WHOLE)


def e164(col: Column | str, default_cc: str = "1") -> Column:
    """``+`` and 8 to 15 digits; ten-digit numbers get the default country code; anything else is null."""
    raw = F.trim(_c(col))
    digits = F.regexp_replace(raw, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(raw.startswith("+") & n.between(8, 15), F.concat(F.lit("+"), digits))
        .when(n == 10, F.concat(F.lit("+" + default_cc), digits))
        .when((n == 10 + len(default_cc)) & digits.startswith(default_cc), F.concat(F.lit("+"), digits))
    )


def std_space(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(col), r"[ \t\r\n]+", " "))


def std_name(col: Column | str) -> Column:
    """Single spaces, first letter of each word in upper case."""
    return F.initcap(F.lower(std_space(col)))


def std_code(col: Column | str) -> Column:
    """Upper case without spaces."""
    return F.upper(F.regexp_replace(_c(col), r"[ \t\r\n]+", ""))


def match_text(col: Column | str) -> Column:
    """Lower-case letters and digits only, single spaces: the form in which texts are compared."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), r"[^a-z0-9]+", " "))


def std_date(col: Column | str, formats: list[str]) -> Column:
    """First format that reads the text gives the date."""
    return F.coalesce(*[F.try_to_timestamp(_c(col), F.lit(f)).cast("date") for f in formats])


def is_future(col: Column | str, as_of: str) -> Column:
    return _c(col).cast("date") > F.lit(as_of).cast("date")


# Postal abbreviations of street words.
STREET_WORDS = {
    "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "LANE": "LN", "ROAD": "RD",
    "COURT": "CT", "PLACE": "PL", "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
    "SUITE": "STE", "APARTMENT": "APT",
}


def std_address(col: Column | str) -> Column:
    """Upper case, no punctuation, single spaces, street words abbreviated."""
    text = F.trim(F.regexp_replace(F.upper(_c(col)), r"[^A-Z0-9]+", " "))
    return reduce(lambda c, w: F.regexp_replace(c, rf"\b{w[0]}\b", w[1]), STREET_WORDS.items(), text)


def month_end(col: Column | str) -> Column:
    """Last day of an ``MM/yyyy`` card expiry."""
    return F.last_day(F.try_to_date(F.concat(F.lit("01/"), _c(col)), "dd/MM/yyyy"))


# -- validity ----------------------------------------------------------------------------------------

def luhn_ok(col: Column | str) -> Column:
    return F.call_function("luhn_check", _c(col))


def aba_ok(col: Column | str) -> Column:
    """Nine digits whose 3-7-1 weighted sum is a multiple of ten."""
    c = _c(col)
    total = sum((F.substring(c, i + 1, 1).try_cast("int") * w for i, w in enumerate((3, 7, 1) * 3)), F.lit(0))
    return F.coalesce(c.rlike("^[0-9]{9}$") & (total % 10 == 0), F.lit(False))


def npi_format_ok(col: Column | str) -> Column:
    return _c(col).rlike("^[12][0-9]{9}$")


def npi_ok(col: Column | str) -> Column:
    """Ten digits with the check digit computed over the issuer prefix 80840."""
    return npi_format_ok(col) & F.call_function("luhn_check", F.concat(F.lit("80840"), _c(col)))


def bic_ok(col: Column | str) -> Column:
    """Four letters, two-letter country, two characters of location, optional branch of three."""
    return _c(col).rlike("^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$")


# Shapes of clinical codes.
ICD10 = r"^[A-Z][0-9][0-9A-Z](\.[0-9A-Z]{1,4})?$"
CPT = r"^([0-9]{5}|[A-Z][0-9]{4}|[0-9]{4}[A-Z])$"
LOINC = r"^[0-9]{1,7}-[0-9]$"
NDC = r"^[0-9]{5}-[0-9]{4}-[0-9]{2}$"


# -- exact sums ----------------------------------------------------------------------------------------

SCALE = 12  # digits after the point that a sum of doubles keeps where the caller names none


def exact(df: DataFrame, col: str, scale: int | None = None) -> Column:
    """The column as a type whose sums do not depend on the order of addition.

    Decimals and whole numbers keep their own type. Doubles become decimals with ``scale`` digits after the
    point; a value that loses more than a millionth of itself that way, or does not fit, is an error and not
    a silent zero.
    """
    kind, c = df.schema[col].dataType, F.col(col)
    if isinstance(kind, T.DecimalType):
        return c
    if isinstance(kind, T.IntegralType):
        return c.cast("decimal(19,0)")
    digits = SCALE if scale is None else scale
    d = c.cast(f"decimal({18 if digits <= 4 else 38},{digits})")
    lost = F.abs(d.cast("double") - c) > F.abs(c) * 1e-6
    return F.when(lost, F.raise_error(F.concat(F.lit(f"{col} needs more than {digits} digits after the point: "), c.cast("string")))
                  .cast(f"decimal({18 if digits <= 4 else 38},{digits})")).otherwise(d)


def exact_square(df: DataFrame, col: str, scale: int | None = None) -> Column:
    """Squares whose sums do not depend on the order of addition: exact for short decimals, else from doubles with 2 x ``scale`` digits, 14 at most."""
    kind = df.schema[col].dataType
    e = exact(df, col, scale)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (e * e).cast(f"decimal(38,{2 * kind.scale})")
    if isinstance(kind, T.IntegralType):
        return e.cast("decimal(18,0)") * e.cast("decimal(18,0)")
    digits = SCALE if scale is None else scale
    if digits <= 4 and not isinstance(kind, T.DecimalType):
        return (e * e).cast(f"decimal(38,{2 * digits})")
    return (F.col(col).cast("double") * F.col(col).cast("double")).cast(f"decimal(38,{min(2 * digits, 14)})")


# -- de-identification -------------------------------------------------------------------------------

def token(col: Column | str, key: str) -> Column:
    """Keyed SHA-256 of the value: stable per value and key."""
    return F.sha2(F.concat(F.lit(key), _c(col).cast("string")), 256)


def zip3(col: Column | str, small: list[str]) -> Column:
    """First three digits; thinly populated areas become 000."""
    head = F.substring(_c(col), 1, 3)
    return F.when(head.isin(small), F.lit("000")).otherwise(head) if small else head


def age_years(dob: Column | str, as_of: str) -> Column:
    return F.floor(F.months_between(F.lit(as_of).cast("date"), _c(dob).cast("date")) / 12)


def age_band(dob: Column | str, as_of: str, top: int = 90, width: int = 10) -> Column:
    """Ten-year bands; everybody above 89 shares one."""
    age = age_years(dob, as_of)
    low = F.floor(age / width) * width
    return F.when(age >= top, F.lit(f"{top}+")).when(age >= 0, F.concat_ws("-", low.cast("string"), (low + width - 1).cast("string")))


def key_days(key_col: Column | str, key: str, width: int = 365) -> Column:
    """A stable offset of 1 to ``width`` days for a subject; a subject without identifier gets none (null)."""
    return (digest_number(F.concat(F.lit(key), F.lit("|"), _c(key_col).cast("string"))) % width).cast("int") + 1


def digest_number(text: Column, start: int = 1, digits: int = 8) -> Column:
    """Hexadecimal digits of the text's MD5 as a whole number: a hash that every engine has."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("long")
