"""Identifiers and sensitive values over all tables and columns; drift between the two halves of a table."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from assay.checks.discovery import ALL, columns_of
from assay.checks.registry import SCHEMAS, Tables, query
from assay.functions import patterns
from assay.operators import govern as G, identifiers, profile

TYPED = {"Dates (except year)": ("timestamp_ntz",)}


def flags_sql() -> str:
    parts = []
    for table in SCHEMAS:
        for c, kind in columns_of(SCHEMAS[table]):
            for name, r in identifiers.RULES.items():
                hits = f"count(*) FILTER (regexp_matches({c}, '{r.value}'))" if kind == "string" and r.value else "0"
                parts.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{name}' AS identifier, regexp_matches('{c}', '{r.name}') AS by_name, "
                             f"{str(kind in TYPED.get(name, ())).lower()} AS by_type, {hits} AS hits, count({c}) AS filled FROM {table}")
    return f"SELECT *, by_name OR by_type OR hits > 0 AS found FROM ({' UNION ALL '.join(parts)})"


def flags(t: Tables) -> DataFrame:
    return reduce(DataFrame.unionByName, [identifiers.identifier_flags(getattr(t, n), n) for n in ALL])


@query("b5_identifiers_everywhere", flags_sql())
def identifiers_everywhere(t: Tables) -> DataFrame:
    return flags(t)


@query("b5_identifiers_by_table", f"""
WITH p AS (SELECT identifier, table_name, bool_or(found) AS has FROM ({flags_sql()}) f GROUP BY ALL)
SELECT identifier, bool_or(has) AS found, count(*) FILTER (has) AS tables_with, count(*) AS tables_checked FROM p GROUP BY identifier
""")
def identifiers_by_table(t: Tables) -> DataFrame:
    return profile.identifier_summary(flags(t), "identifier", "found")


@query("e28_identifiers_treated", """
SELECT sha256('k' || c_custkey::VARCHAR) AS c_custkey, sha256('k' || c_name) AS c_name, sha256('k' || c_nationkey::VARCHAR) AS c_nationkey, c_acctbal, c_mktsegment FROM {customer_dirty}
""")
def treated(t: Tables) -> DataFrame:
    out, _ = identifiers.deidentified(t.customer_dirty, "customer", "k")
    return out


def _scrubbed(c: str) -> str:
    from assay.operators.deid import FREE_TEXT
    return reduce(lambda x, p: f"regexp_replace({x}, '{p[0]}', '{p[1]}', 'g')", FREE_TEXT, c)


@query("e28_identifiers_in_texts", f"SELECT sha256('k' || doc_id::VARCHAR) AS doc_id, md5({_scrubbed('text')}) AS text, lang, source, n_chars FROM documents")
def treated_texts(t: Tables) -> DataFrame:
    out, _ = identifiers.deidentified(t.documents, "documents", "k")
    return out.withColumn("text", F.md5(F.col("text").cast("binary")))


TEXTS = {n: [c for c, kind in columns_of(s) if kind == "string"] for n, s in SCHEMAS.items()}
TEXTS = {n: cs for n, cs in TEXTS.items() if cs}


def sensitive_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{k}' AS kind, regexp_matches('{c}', '{n}') AS by_name, "
        f"count(*) FILTER (regexp_matches({c}, '{v}')) AS hits, count({c}) AS values FROM {t}"
        for t, cs in TEXTS.items() for c in cs for k, (n, v) in patterns.SENSITIVE.items())


def sensitive(t: Tables) -> DataFrame:
    return reduce(DataFrame.unionByName, [profile.detect_sensitive(getattr(t, n), n) for n in TEXTS])


@query("b4_sensitive_everywhere", f"SELECT *, by_name OR hits > 0 AS flagged FROM ({sensitive_sql()})")
def sensitive_everywhere(t: Tables) -> DataFrame:
    return sensitive(t)


@query("b10_sensitive_lists_everywhere", f"""
SELECT table_name, count(DISTINCT column_name) AS n_columns, string_agg(DISTINCT column_name, ',' ORDER BY column_name) AS columns FROM ({sensitive_sql()}) f
WHERE by_name OR hits > 0 GROUP BY table_name
""")
def lists_everywhere(t: Tables) -> DataFrame:
    return profile.sensitive_columns(sensitive(t)).withColumn("columns", F.array_join("columns", ","))


@query("g6_key_drift_halves", """
WITH a AS (SELECT DISTINCT event_type || '_' || user_id AS c FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT event_type || '_' || user_id AS c FROM events WHERE event_id % 2 = 1)
SELECT coalesce(a.c, b.c) AS column_name, CASE WHEN a.c IS NULL THEN 'added' ELSE 'removed' END AS change FROM a FULL JOIN b ON a.c = b.c WHERE a.c IS NULL OR b.c IS NULL
""")
def drift_halves(t: Tables) -> DataFrame:
    """The columns a pivot of either half of the events would have; the two halves together are the whole table."""
    keys = lambda df: df.select(F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("column_name")).distinct().withColumn("data_type", F.lit("double"))
    return G.schema_drift(keys(t.events.where("event_id % 2 = 0")), keys(t.events.where("event_id % 2 = 1"))).select("column_name", "change")


EVERY = {n: [c for c, k in columns_of(s) if k in ("int", "bigint", "string", "timestamp_ntz")] for n, s in SCHEMAS.items() if n in ("orders", "lineitem", "customer", "events", "labels")}


def exact_sql(table: str) -> str:
    """Every column whose text form both engines share (times to the second's fraction as they are shown)."""
    shown = lambda c, k: f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if k == "timestamp_ntz" else f"CAST({c} AS VARCHAR)"
    parts = []
    for c, k in columns_of(SCHEMAS[table]):
        if c in EVERY[table]:
            parts.append(f"""SELECT '{table}' AS table_name, '{c}' AS column_name, sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS nulls, count(v) AS distinct_count,
  arg_min(v, (-n, v)) FILTER (v IS NOT NULL) AS top_value, max(n) FILTER (v IS NOT NULL) AS top_rows FROM (SELECT {shown(c, k)} AS v, count(*) AS n FROM {table} GROUP BY 1)""")
    return " UNION ALL ".join(parts)


@query("b3_profile_exact_everywhere", " UNION ALL ".join(map(exact_sql, EVERY)))
def exact_everywhere(t: Tables) -> DataFrame:
    out = []
    for n, cs in EVERY.items():
        df = getattr(t, n).select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if dict(columns_of(SCHEMAS[n]))[c] == "timestamp_ntz" else F.col(c) for c in cs])
        out.append(profile.profile_exact(df).select(F.lit(n).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, out)
