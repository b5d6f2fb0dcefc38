"""Data-quality rules: row rules in one projection, key rules through counts per key, quarantine.

A row rule is a boolean column. All row rules of a table are counted in a single aggregate. Uniqueness
and foreign keys are counted on one line per key, so a hot key costs no more than any other.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assay.functions import columns as fx, patterns
from assay.operators.ordered import join_null_safe, rolling, sized
from assay.session import cut


@dataclass(frozen=True)
class Row:
    """Passes where ``ok`` is true; an undecided (null) outcome counts as failed."""
    id: str
    ok: Column
    label: str = ""


@dataclass(frozen=True)
class Unique:
    """Every row whose key occurs more than once fails."""
    id: str
    cols: list[str] = field(default_factory=list)
    label: str = ""


@dataclass(frozen=True)
class Exists:
    """The columns must be found in the parent; rows with a null key pass only if ``null_ok``."""
    id: str
    cols: list[str]
    parent: DataFrame
    parent_cols: list[str]
    null_ok: bool = True
    label: str = ""


Rule = Row | Unique | Exists


# -- outcomes ----------------------------------------------------------------------------------------

def pass_rate(passed: Column, rows: Column) -> Column:
    """Percentage with one decimal, half up, in integer arithmetic; 0.0 for an empty table."""
    n = F.greatest(rows, F.lit(1))
    return F.floor((2000 * passed + n) / (2 * n)) / 10.0


def status(passed: Column, rows: Column) -> Column:
    """PASS from 95 %, WARN from 80 %, else FAIL."""
    return (
        F.when((rows > 0) & (100 * passed >= 95 * rows), "PASS")
        .when((rows > 0) & (100 * passed >= 80 * rows), "WARN").otherwise("FAIL")
    )


def severity(failed: Column, rows: Column, graded: bool = True) -> Column:
    """No failure info; below ten per cent warn; else error. Ungraded: any failure is warn."""
    if not graded:
        return F.when(failed == 0, "info").otherwise("warn")
    return F.when(failed == 0, "info").when(10 * failed < rows, "warn").otherwise("error")


def outcome(counts: DataFrame, graded: bool = True) -> DataFrame:
    """Add passed, pass_rate, status and severity to (…, rows, failed)."""
    passed = F.col("rows") - F.col("failed")
    return counts.withColumns({
        "passed": passed, "pass_rate": pass_rate(passed, F.col("rows")), "status": status(passed, F.col("rows")),
        "severity": severity(F.col("failed"), F.col("rows"), graded),
    })


# -- engine ------------------------------------------------------------------------------------------

def _failed(rule: Row) -> Column:
    return ~F.coalesce(rule.ok, F.lit(False))


def _all_filled(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def _parent_keys(rule: Exists) -> DataFrame:
    return rule.parent.select(*[F.col(p).alias(c) for p, c in zip(rule.parent_cols, rule.cols)]).distinct()


class KeyLines:
    """Rows per key for several sets of key columns, counted in one scan of the table and stored.

    All key rules of a table, its quarantine and its key figures can read these lines instead of the table.
    """

    def __init__(self, df: DataFrame, sets: list[list[str]]):
        self.sets = [list(s) for s in dict.fromkeys(tuple(s) for s in sets)]
        columns = list(dict.fromkeys(c for s in self.sets for c in s))
        # a set is told by its grouping number, so a null key is not taken for a column that the set lacks
        self.number = {tuple(s): sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s) for s in self.sets}
        if len(self.sets) == 1:
            counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("__set"))
            self.number = {tuple(self.sets[0]): 0}
        else:
            counted = df.select(*columns).groupingSets([[F.col(c) for c in s] for s in self.sets], *columns).agg(
                F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("__set"))
        self.lines = cut(counted)

    def of(self, cols: list[str]) -> DataFrame:
        """(cols, n): one line per key."""
        return self.lines.where(F.col("__set") == self.number[tuple(cols)]).select(*cols, "n")


def key_lines(df: DataFrame, rules: list[Rule], more: list[list[str]] | None = None) -> KeyLines | None:
    """Lines for all key rules, and for more sets of columns; None if there are none."""
    sets = [r.cols for r in rules if not isinstance(r, Row)] + (more or [])
    return KeyLines(df, sets) if sets else None


def _bad_keys(keys: DataFrame, rule: Unique | Exists) -> DataFrame:
    """The offending keys among a rule's key lines."""
    if isinstance(rule, Unique):
        return keys.where("n > 1")
    missing = keys.join(_parent_keys(rule), rule.cols, "left_anti")
    return missing.where(_all_filled(rule.cols)) if rule.null_ok else missing


def run_rules(df: DataFrame, table: str, rules: list[Rule], graded: bool = True, lines: KeyLines | None = None) -> DataFrame:
    """(table_name, rule_id, rows, failed, passed, pass_rate, status, severity), one line per rule.

    One scan for all row rules; one for all key rules together, none if their ``lines`` are given.
    """
    key_rules = [r for r in rules if not isinstance(r, Row)]
    if lines is None and len(key_rules) > 1:
        lines = key_lines(df, rules)
    row_rules = [r for r in rules if isinstance(r, Row)]
    base = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(_failed(r)).alias(f"f{i}") for i, r in enumerate(row_rules)])
    parts = []
    if row_rules:
        parts.append(base.select(F.explode(F.array(*[
            F.struct(F.lit(r.id).alias("rule_id"), F.col("rows"), F.col(f"f{i}").alias("failed"))
            for i, r in enumerate(row_rules)])).alias("r")).select("r.*"))
    for r in rules:
        if isinstance(r, Row):
            continue
        keys = lines.of(r.cols) if lines else df.groupBy(*r.cols).agg(F.count(F.lit(1)).alias("n"))
        if isinstance(r, Unique):
            bad = F.col("n") > 1
        else:
            keys = keys.join(_parent_keys(r).withColumn("__hit", F.lit(True)), r.cols, "left")
            bad = F.col("__hit").isNull() & (_all_filled(r.cols) if r.null_ok else F.lit(True))
        parts.append(keys.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("failed"),
        ).select(F.lit(r.id).alias("rule_id"), "rows", "failed"))
    counts = reduce(DataFrame.unionByName, parts).select(F.lit(table).alias("table_name"), "*")
    return outcome(counts, graded)


def judge(df: DataFrame, rules: list[Rule], lines: KeyLines | None = None) -> DataFrame:
    """The rows with ``failed_rules``, the names of the rules each one breaks.

    Key rules find their offending keys in ``lines``, which one scan counts if they are not given.
    Only the offending keys of key rules are joined back. They are stored and counted first: when few,
    the table is not shuffled at all; when many, the join shuffles and Spark splits skewed partitions.
    """
    out, flags = df, []
    lines = lines or key_lines(df, rules)
    for i, r in enumerate(rules):
        if isinstance(r, Row):
            flags.append(F.when(_failed(r), F.lit(r.id)))
            continue
        bad = _bad_keys(lines.of(r.cols), r).select(*r.cols)
        out = join_null_safe(out, sized(bad).withColumn(f"__bad{i}", F.lit(True)), r.cols)
        flags.append(F.when(F.col(f"__bad{i}"), F.lit(r.id)))
    return out.withColumn("failed_rules", F.array_compact(F.array(*flags))).select(*df.columns, "failed_rules")


def quarantine(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every rule, rows that fail at least one with the rule names)."""
    judged = judge(df, rules)
    return judged.where(F.size("failed_rules") == 0).drop("failed_rules"), judged.where(F.size("failed_rules") > 0)


def quarantine_summary(df: DataFrame, table: str, rules: list[Rule], lines: KeyLines | None = None) -> DataFrame:
    """Rows in, distinct rows quarantined, rows left for Gold, and the sum of failures over rules."""
    return judge(df, rules, lines).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.size("failed_rules") > 0).alias("quarantined"),
        F.coalesce(F.sum(F.size("failed_rules")), F.lit(0)).cast("long").alias("failures"),
    ).select(
        F.lit(table).alias("table_name"), "rows", "quarantined", "failures",
        (F.col("rows") - F.col("quarantined")).alias("gold_rows"),
        F.greatest(F.col("rows") - F.col("failures"), F.lit(0)).alias("gold_rows_double_counted"),
    )


def remediation(results: DataFrame) -> DataFrame:
    """Tables with at least one rule below PASS."""
    return results.groupBy("table_name").agg(
        F.count_if(F.col("status") != "PASS").alias("open_rules"), F.min("pass_rate").alias("worst_rate"),
    ).where("open_rules > 0")


# -- row rules ---------------------------------------------------------------------------------------

def null_rule(col: str, id: str | None = None) -> Row:
    return Row(id or f"null_check:{col}", F.col(col).isNotNull())


def null_share_ok(df: DataFrame, cols: list[str], max_pct: float) -> DataFrame:
    """Column-level form: does the null percentage stay within the threshold taken from the profile?"""
    agg = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{c}") for c in cols])
    return agg.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col("rows"), (F.col("rows") - F.col(f"n_{c}")).alias("nulls"),
        (100.0 * (F.col("rows") - F.col(f"n_{c}")) <= F.col("rows") * F.lit(max_pct)).alias("ok")) for c in cols])).alias("p")).select("p.*")


def range_rule(col: str, lo=None, hi=None, id: str | None = None) -> Row:
    """Inside the closed bounds; null is the null rule's business."""
    c = F.col(col)
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (c >= lo)
    if hi is not None:
        ok = ok & (c <= hi)
    return Row(id or f"range:{col}", c.isNull() | ok)


def regex_rule(col: str, kind: str, id: str | None = None) -> Row:
    shape = {"email": patterns.EMAIL_WHOLE, "phone": patterns.PHONE_WHOLE, "ssn": patterns.SSN_WHOLE, "ip": patterns.IP_WHOLE}
    return Row(id or f"regex:{col}", F.col(col).isNull() | F.col(col).rlike(shape.get(kind, kind)))


def in_rule(col: str, values: list, id: str | None = None) -> Row:
    return Row(id or f"accepted:{col}", F.col(col).isNull() | F.col(col).isin(values))


def implies_rule(id: str, given: Column, then: Column) -> Row:
    return Row(id, ~F.coalesce(given, F.lit(False)) | F.coalesce(then, F.lit(False)))


def all_present(id: str, cols: list[str], shapes: dict[str, str] | None = None) -> Row:
    """Every column is filled and, where a shape is given, fits it."""
    tests = [F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in cols]
    tests += [F.col(c).rlike(p) for c, p in (shapes or {}).items()]
    return Row(id, reduce(lambda a, b: a & b, tests))


def code_rule(col: str, pattern: str, codes: list[str] | None = None, id: str | None = None) -> Row:
    """Shape of a code and, given a short list, membership. A long list goes into an Exists rule."""
    ok = F.col(col).rlike(pattern)
    return Row(id or f"code:{col}", ok & F.col(col).isin(codes) if codes else ok)


def date_rule(id: str, pairs: list[tuple[str, str]], as_of: str | None = None, not_future: list[str] | None = None) -> Row:
    """Each first date is not after the second; listed dates are not after the as-of day. Null passes."""
    tests = [F.coalesce(F.col(a) <= F.col(b), F.lit(True)) for a, b in pairs]
    tests += [~F.coalesce(fx.is_future(c, as_of), F.lit(False)) for c in (not_future or [])]
    return Row(id, reduce(lambda a, b: a & b, tests))


def luhn_rule(col: str, id: str | None = None) -> Row:
    return Row(id or f"luhn:{col}", fx.luhn_ok(col))


def aba_rule(col: str, id: str | None = None) -> Row:
    return Row(id or f"aba:{col}", F.col(col).isNull() | fx.aba_ok(col))


def bic_rule(bic: str, country: str, home: str = "US", id: str | None = None) -> Row:
    """Shape where present; present wherever the country is foreign."""
    return Row(id or f"bic:{bic}", F.when(F.col(bic).isNull(), F.coalesce(F.col(country) == home, F.lit(True)))
               .otherwise(fx.bic_ok(bic)))


def timeliness_rule(id: str, opened: str, filed: str, due: Column, days: int = 30) -> Row:
    """Where filing is due, it is dated and at most ``days`` after opening."""
    late = F.datediff(F.col(filed).cast("date"), F.col(opened).cast("date")) <= days
    return implies_rule(id, due, F.col(filed).isNotNull() & late)


def lab_rule(value: str = "result_value", high: str = "reference_high", id: str = "lab_range") -> Row:
    """Not negative and at most three times the upper reference bound."""
    return Row(id, (F.col(value) >= 0) & (F.col(value) <= 3 * F.col(high)))


def lab_flag(value: Column, low: Column, high: Column, critical: Column) -> Column:
    """N, H, L or C, recomputed from the bounds."""
    return (
        F.when(value > high, F.when(value > critical, "C").otherwise("H"))
        .when(value < low, F.when(value > 0, "L").otherwise("C")).otherwise("N")
    )


def dose_rule(dose: str, standard: str, factor: float = 5.0, id: str = "medication_safety") -> Row:
    """Dose within ``factor`` times the standard dose already joined from the drug table.

    Ours, not a clinical authority: the caller chooses the factor and supplies the doses.
    """
    d = F.col(dose).try_cast("double")
    return Row(id, F.col(standard).isNull() | ((d > 0) & (d <= factor * F.col(standard))))


def claim_rule(id: str = "claim_integrity", check_digit: bool = False) -> Row:
    """Paid at most billed, well-formed provider number, claimed on or after service, denial has a reason."""
    npi = fx.npi_ok("npi") if check_digit else fx.npi_format_ok("npi")
    return Row(id, (F.col("paid_amount") <= F.col("billed_amount")) & npi & (F.col("claim_date") >= F.col("service_date"))
               & ((F.col("claim_status") != "DENIED") | F.col("denial_reason").isNotNull()))


# -- table rules -------------------------------------------------------------------------------------

def volume_rule(counts: DataFrame, order: str, n: str = "rows", k: float = 3.0, history: int = 2) -> DataFrame:
    """Counts per load against the mean and deviation of all earlier loads; ``counts`` has one line per load."""
    before = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    mean, sd, seen = F.avg(n).over(before), F.stddev_pop(n).over(before), F.count(n).over(before)
    return counts.withColumns({"mean_before": mean, "sd_before": sd}).withColumn(
        "anomaly", F.coalesce((seen >= history) & (F.abs(F.col(n) - mean) > k * sd), F.lit(False)))


def freshness_rule(df: DataFrame, ts: str, as_of: str, limit_hours: float = 24.0) -> DataFrame:
    """Newest row, its age in hours, and the rows older than the limit."""
    edge = F.lit(as_of).cast("timestamp_ntz")
    age = (F.unix_seconds(edge.cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp")))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.max(ts).alias("newest"),
        F.min(age).alias("age_seconds"), F.count_if(age > int(limit_hours * 3600)).alias("stale_rows"),
    ).withColumn("fresh", F.col("age_seconds") <= int(limit_hours * 3600))


def velocity_rule(df: DataFrame, key: str, ts: str, amount: Column, limits: dict[str, tuple[int, int, float]]) -> DataFrame:
    """Trailing count and sum per window (suffix: seconds, most events, largest sum); one line per (key, second)."""
    ticks = rolling(df, [key], ts, {"n": F.lit(1).cast("long"), "amount": amount},
                    {k: s for k, (s, _, _) in limits.items()}, tick="second")
    return ticks.withColumns({
        f"over_{k}": (F.col(f"n_{k}") > most) | (F.col(f"amount_{k}") > largest) for k, (_, most, largest) in limits.items()})


def gold_aggregate(df: DataFrame, dims: list[str], measures: dict[str, tuple], mode: str = "plain",
                   sets: list[list[str]] | None = None) -> DataFrame:
    """Aggregates by dimension, with sub-totals for rollup, cube and grouping sets.

    Measures are ("count",), ("sum", e), ("avg", e), ("min", e) or ("max", e). They are first computed at
    the finest grain, so that sub-totals multiply a few group lines and not the rows of the table.
    """
    fine, total, final = [], [], []
    for name, (kind, *expr) in measures.items():
        e = expr[0] if expr else F.lit(1)
        if kind in ("count", "avg"):
            fine.append(F.count(e).alias(f"{name}__c"))
            total.append(F.sum(f"{name}__c").alias(f"{name}__c"))
        if kind in ("sum", "avg"):
            fine.append(F.sum(e).alias(f"{name}__s"))
            total.append(F.sum(f"{name}__s").alias(f"{name}__s"))
        if kind in ("min", "max"):
            fold = F.min if kind == "min" else F.max
            fine.append(fold(e).alias(f"{name}__s"))
            total.append(fold(f"{name}__s").alias(f"{name}__s"))
        final.append((F.col(f"{name}__c") if kind == "count" else F.col(f"{name}__s") if kind != "avg"
                      else F.col(f"{name}__s").cast("double") / F.col(f"{name}__c")).alias(name))
    grain = df.groupBy(*dims).agg(*fine)
    if mode == "plain":
        return grain.select(*dims, *final)
    grouped = {
        "rollup": lambda: grain.rollup(*dims), "cube": lambda: grain.cube(*dims),
        "sets": lambda: grain.groupingSets([[F.col(c) for c in s] for s in (sets or [])], *dims),
    }[mode]()
    return grouped.agg(*total, F.grouping_id().alias("grouping_id")).select(*dims, *final, "grouping_id")
