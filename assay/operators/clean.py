"""Bronze to Silver: imputation, de-duplication, history, standard forms, cross-table repairs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assay.functions import columns as fx
from assay.operators.meets import as_of
from assay.operators.ordered import exact_quantiles, first_rows, hot_keys, join_null_safe, neighbour, sized
from assay.operators.rules import judge
from assay.session import cut

# -- imputation ---------------------------------------------------------------------------------------


def _fill_value(df: DataFrame, col: str, how: tuple, scale: int | None) -> Column | None:
    kind = how[0]
    if kind == "constant":
        return F.lit(how[1])
    if kind == "mean":
        return df.agg(F.sum(fx.exact(df, col, scale)).cast("double") / F.count(col)).scalar()
    if kind == "median":
        return exact_quantiles(df, col, {"m": 0.5}).agg(F.max("value")).scalar()
    if kind == "mode":
        counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(col).alias("v"))).getField("v")).scalar()
    return None


def impute(df: DataFrame, plan: dict[str, tuple], scale: int | None = None) -> DataFrame:
    """Fill nulls; ``{col}_imputed`` tells which values are not original.

    Plans: ("constant", v), ("mean",), ("median",), ("mode",), ("group_mean", group column), ("flag",).
    Global figures are scalar subqueries; group means come from one condensed line per group. Means are exact
    sums over counts; ``scale`` is the number of digits that doubles carry (see ``columns.exact``).
    """
    out = df.withColumns({f"{c}_imputed": F.col(c).isNull() for c in plan})
    for c, how in plan.items():
        if how[0] == "flag":
            continue
        if how[0] == "group_mean":
            means = df.groupBy(how[1]).agg(
                (F.sum(fx.exact(df, c, scale)).cast("double") / F.count(c)).alias(f"__m_{c}"))
            out = join_null_safe(out, sized(means), [how[1]])
            out = out.withColumn(c, F.coalesce(c, F.col(f"__m_{c}"))).drop(f"__m_{c}")
        else:
            out = out.withColumn(c, F.coalesce(F.col(c), _fill_value(df, c, how, scale)))
    return out


def imputed_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(f"{c}_imputed")).alias(c) for c in cols])


# -- duplicates and history ---------------------------------------------------------------------------

def dedupe(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the first in ``order`` (pass descending columns to keep the latest)."""
    return first_rows(df, keys, order)


def dedupe_on(df: DataFrame, keys: dict[str, Column], order: list[Column | str]) -> DataFrame:
    """De-duplicate on computed keys, such as name + birth date + last four digits."""
    marked = df.withColumns({f"__k_{n}": e for n, e in keys.items()})
    names = [f"__k_{n}" for n in keys]
    return first_rows(marked, names, order).drop(*names)


def row_hash(attrs: list[str]) -> Column:
    """SHA-256 over the attributes; nulls and field borders are distinguishable."""
    parts = [F.coalesce(F.concat(F.length(F.col(a).cast("string")).cast("string"), F.lit(":"), F.col(a).cast("string")), F.lit("-")) for a in attrs]
    return F.sha2(F.concat_ws("|", *parts), 256)


def scd2_history(df: DataFrame, key: str, ts: str, attrs: list[str], tiebreak: list[str] | None = None,
                 hot_rows: int | None = None) -> DataFrame:
    """Versions of each key from its whole record: a row opens a version when an attribute changes."""
    order = [ts, *(tiebreak or [])]
    hashed = df.select(key, *order, *[a for a in attrs if a not in order], row_hash(attrs).alias("row_hash"))
    hot = hot_keys(hashed, [key], order, hot_rows)
    before = neighbour(hashed, [key], order, {"__before": ("row_hash", 1)}, hot=hot)
    opened = before.where(F.col("__before").isNull() | (F.col("__before") != F.col("row_hash"))).drop("__before")
    if hot is not None:
        opened = cut(opened)
    closed = neighbour(opened, [key], order, {"valid_to": (ts, 1)}, following=True, hot=hot)
    return closed.withColumnRenamed(ts, "valid_from").withColumn("is_current", F.col("valid_to").isNull())


def scd2_merge(dim: DataFrame, batch: DataFrame, key: str, attrs: list[str], ts: str) -> DataFrame:
    """Apply one batch (one row per key): close changed versions, open new ones, keep the rest.

    Applying the same batch twice changes nothing.
    """
    incoming = batch.select(F.col(key).alias("__key"), F.col(ts).alias("__ts"), row_hash(attrs).alias("__hash"))
    joined = dim.join(incoming, F.col("is_current") & (F.col(key) == F.col("__key")), "left")
    changes = F.col("__hash").isNotNull() & (F.col("__hash") != row_hash(attrs))
    kept = joined.withColumns({
        "valid_to": F.when(changes, F.col("__ts")).otherwise(F.col("valid_to")),
        "is_current": F.when(changes, F.lit(False)).otherwise(F.col("is_current")),
    }).select(*dim.columns)
    now = dim.where("is_current").select(F.col(key).alias("__key"), row_hash(attrs).alias("__now"))
    fresh = batch.join(now, F.col(key) == F.col("__key"), "left").where(
        F.col("__now").isNull() | (F.col("__now") != row_hash(attrs)))
    opened = fresh.select(*[
        F.col(ts).alias("valid_from") if c == "valid_from" else
        F.lit(None).cast(dim.schema["valid_to"].dataType).alias(c) if c == "valid_to" else
        F.lit(True).alias(c) if c == "is_current" else F.col(c)
        for c in dim.columns])
    return kept.unionByName(opened)


# -- standard forms -----------------------------------------------------------------------------------

def repaired(df: DataFrame, fixes: dict[str, Column]) -> DataFrame:
    """Apply fixes in place; ``{col}_repaired`` marks values that changed."""
    changed = {f"{c}_repaired": ~F.col(c).eqNullSafe(e) for c, e in fixes.items()}
    return df.withColumns({f"__{c}": e for c, e in fixes.items()} | changed).withColumns(
        {c: F.col(f"__{c}") for c in fixes}).drop(*[f"__{c}" for c in fixes])


def repair_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(f"{c}_repaired")).alias(c) for c in cols])


def fill_from(df: DataFrame, ref: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """Fill nulls of ``cols`` from a reference table with one row per key.

    Spark broadcasts the reference only when its measured size allows; otherwise the join shuffles and
    skewed partitions are split.
    """
    side = ref.select(*on, *[F.col(c).alias(f"__ref_{c}") for c in cols])
    return df.join(side, on, "left").withColumns({c: F.coalesce(c, f"__ref_{c}") for c in cols}).drop(
        *[f"__ref_{c}" for c in cols])


def map_codes(df: DataFrame, col: str, mapping: dict[str, str] | DataFrame, out: str, default: str | None = None) -> DataFrame:
    """Translate codes; a dict becomes a literal map, a table (``code``, ``target``) a join."""
    fallback = F.lit(default) if default is not None else F.lit(None).cast("string")
    if isinstance(mapping, DataFrame):
        side = mapping.select(F.col("code").alias("__code"), F.col("target").alias("__target"))
        return df.join(side, F.col(col) == F.col("__code"), "left").withColumn(
            out, F.coalesce("__target", fallback)).drop("__code", "__target")
    literal = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.coalesce(literal[F.col(col)], fallback))


# -- status and dates ---------------------------------------------------------------------------------

def dormancy(df: DataFrame, last_activity: str, flag: str | None, as_of: str, days: int = 365) -> DataFrame:
    """``dormant`` after more than ``days`` without activity; ``unflagged`` where the flag does not say so."""
    idle = F.datediff(F.lit(as_of).cast("date"), F.col(last_activity).cast("date"))
    out = df.withColumns({"idle_days": idle, "dormant": F.coalesce(idle > days, F.lit(False))})
    known = F.coalesce(F.col(flag).cast("boolean"), F.lit(False)) if flag else F.lit(False)
    return out.withColumn("unflagged", F.col("dormant") & ~known)


def expire_cards(df: DataFrame, as_of: str, expiry: str = "expiry_date", status: str = "status") -> DataFrame:
    """Active cards whose expiry month has ended become EXPIRED."""
    due = (fx.month_end(expiry) < F.lit(as_of).cast("date")) & (F.col(status) == "ACTIVE")
    due = F.coalesce(due, F.lit(False))
    return df.withColumn("status_changed", due).withColumn(status, F.when(F.col("status_changed"), "EXPIRED").otherwise(F.col(status)))


def fix_date_pair(df: DataFrame, start: str, end: str, how: str = "null") -> DataFrame:
    """Repair pairs whose end precedes the start: drop the end, or swap both; ``inverted`` marks them."""
    bad = F.coalesce(F.col(end) < F.col(start), F.lit(False))
    out = df.withColumn("inverted", bad)
    if how == "swap":
        return out.withColumns({start: F.when(bad, F.col(end)).otherwise(F.col(start)), end: F.when(bad, F.col(start)).otherwise(F.col(end))})
    return out.withColumn(end, F.when(~bad, F.col(end)))


def delinquency(df: DataFrame, due: str, paid: Column | str, limits: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """Days past due (never negative) and the bucket they fall into."""
    paid = F.col(paid) if isinstance(paid, str) else paid
    days = F.greatest(F.datediff(paid.cast("date"), F.col(due).cast("date")), F.lit(0))
    bucket = F.when(days == 0, "CURRENT")
    low = 1
    for limit in limits:
        bucket = bucket.when(days < limit, f"{low}-{limit - 1}")
        low = limit
    return df.withColumn("days_past_due", days).withColumn("bucket", bucket.otherwise(f"{low}+"))


def sla_breach(df: DataFrame, opened: str, closed: str | None, n: int, as_of: str | None = None) -> DataFrame:
    end = F.col(closed).cast("date") if closed else F.lit(None).cast("date")
    if as_of:
        end = F.coalesce(end, F.lit(as_of).cast("date"))
    days = F.datediff(end, F.col(opened).cast("date"))
    return df.withColumns({"days_open": days, "breach": F.coalesce(days > n, F.lit(False))})


def expiring(df: DataFrame, col: str, as_of: str, n: int) -> DataFrame:
    """EXPIRED, EXPIRING within ``n`` days, VALID, or UNKNOWN."""
    left = F.datediff(F.col(col).cast("date"), F.lit(as_of).cast("date"))
    return df.withColumns({"days_left": left, "alert": F.when(left.isNull(), "UNKNOWN").when(left < 0, "EXPIRED")
                           .when(left <= n, "EXPIRING").otherwise("VALID")})


# -- cross-table --------------------------------------------------------------------------------------

def reconcile(accounts: DataFrame, key: str, balance: str, ledger: DataFrame, ledger_key: str, signed: Column,
              tol: float = 0.005) -> DataFrame:
    """Stated balance against the sum of the ledger. The ledger is summed per account before the join."""
    sums = ledger.groupBy(F.col(ledger_key).alias("__key")).agg(F.sum(signed).alias("ledger_sum"))
    joined = accounts.select(F.col(key).alias("account"), F.col(balance).cast("decimal(18,2)").alias("balance")).join(
        sums, F.col("account") == F.col("__key"), "full")
    diff = F.coalesce("balance", F.lit(0)) - F.coalesce("ledger_sum", F.lit(0))
    return joined.select(
        F.coalesce("account", "__key").alias("account"), "balance", "ledger_sum", diff.alias("difference"),
        F.when(F.col("account").isNull(), "no_account").when(F.col("ledger_sum").isNull(), "no_ledger")
        .when(F.abs(diff) > tol, "mismatch").otherwise("ok").alias("outcome"),
        F.coalesce(F.col("balance") < 0, F.lit(False)).alias("negative"))


def split_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose parent exists, rows without one)."""
    keys = parent.select(F.col(pk).alias("__pk")).distinct()
    on = F.col(fk) == F.col("__pk")
    return child.join(keys, on, "left_semi"), child.join(keys, on, "left_anti")


def ltv(loans: DataFrame, appraisals: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Outstanding balance over collateral value in per cent; the latest appraisal up to ``as_of`` wins.

    ``appraisals``: (loan_id, appraised_on, value). Of several on one day the highest is taken.
    """
    out = loans
    value = F.col("collateral_value")
    if appraisals is not None:
        known = appraisals if as_of is None else appraisals.where(F.col("appraised_on") <= F.lit(as_of))
        latest = known.groupBy("loan_id").agg(F.max(F.struct("appraised_on", "value")).getField("value").alias("__current"))
        out = out.join(latest, "loan_id", "left")
        value = F.coalesce("__current", "collateral_value")
    ratio = F.when(value > 0, F.round(F.col("outstanding_balance") / value * 100, 2))
    return out.withColumn("ltv_current", ratio).drop("__current")


def ltv_as_of(loans: DataFrame, appraisals: DataFrame, collateral: str, paid_on: str) -> DataFrame:
    """Loan to value at each loan's own payment date: the last appraisal (collateral, appraised_on, value) of its collateral up to then counts."""
    known = as_of(loans, appraisals, [collateral], paid_on, "appraised_on", ["value"])
    ratio = F.when(F.col("value") > 0, F.round(F.col("outstanding_balance") / F.col("value") * 100, 2))
    return known.withColumn("ltv_at_payment", ratio)


def group_moments(df: DataFrame, col: str, by: list[str], scale: int | None = None) -> DataFrame:
    """Mean and population deviation per group from exact decimal sums."""
    n, s, q = F.count(col), F.sum(fx.exact(df, col, scale)).cast("double"), F.sum(fx.exact_square(df, col, scale)).cast("double")
    return df.groupBy(*by).agg(n.alias("__n"), s.alias("__s"), q.alias("__q")).select(
        *by, (F.col("__s") / F.col("__n")).alias("group_mean"),
        F.sqrt(F.greatest(F.col("__q") / F.col("__n") - (F.col("__s") / F.col("__n")) * (F.col("__s") / F.col("__n")), F.lit(0.0))).alias("group_sd"))


def outliers(df: DataFrame, col: str, by: list[str], k: float = 3.0, policy: tuple[float, float] | None = None,
             scale: int | None = None) -> DataFrame:
    """More than ``k`` deviations from the group mean, or outside the policy range.

    Groups may be few and huge, so their moments are aggregated and joined back instead of windowed.
    """
    out = join_null_safe(df, sized(group_moments(df, col, by, scale)), by)
    flag = F.abs(F.col(col) - F.col("group_mean")) > k * F.col("group_sd")
    if policy:
        flag = flag | ~F.col(col).between(*policy)
    return out.withColumn("outlier", F.coalesce(flag, F.lit(False)))


def activity_on_closed(parent: DataFrame, key: str, status: str, facts: DataFrame, fk: str, closed: list[str]) -> DataFrame:
    """Closed parents that still have activity, with the number of facts and the newest key."""
    shut = parent.where(F.col(status).isin(closed))
    busy = facts.groupBy(F.col(fk).alias("__key")).agg(F.count(F.lit(1)).alias("activity"))
    return shut.join(busy, F.col(key) == F.col("__key")).drop("__key")


def compare_to_parent(df: DataFrame, fk: str, parent: DataFrame, pk: str, breach: Column, out: str = "breach") -> DataFrame:
    """Join the parent row and evaluate a condition over both sides; rows without a parent are kept."""
    side = parent.withColumnRenamed(pk, "__pk")
    return df.join(side, F.col(fk) == F.col("__pk"), "left").withColumn(out, F.coalesce(breach, F.lit(False))).drop("__pk")


def address_diff(df: DataFrame, key: str, col: str, filing: DataFrame, filed: str, max_dist: int = 0) -> DataFrame:
    """Normalised address against the filed one, with their edit distance."""
    side = filing.select(F.col(key).alias("__key"), fx.std_address(filed).alias("filed_address"))
    joined = df.withColumn("std_address", fx.std_address(col)).join(side, F.col(key) == F.col("__key"), "left").drop("__key")
    dist = F.levenshtein("std_address", "filed_address")
    return joined.withColumns({"distance": dist, "mismatch": F.coalesce(dist > max_dist, F.lit(True))})


# -- rule-based scores and checks ---------------------------------------------------------------------

def impute_score(df: DataFrame, rules: list[tuple[str, Column, int]], col: str | None = None, cap: int = 100) -> DataFrame:
    """Points of all true conditions, capped; unscored rows take them. ``score_parts`` explains the sum."""
    points = reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for _, c, p in rules])
    parts = F.array_compact(F.array(*[F.when(c, F.concat(F.lit(f"{n}="), F.lit(p))) for n, c, p in rules]))
    total = F.least(points, F.lit(cap))
    out = df.withColumns({"rule_score": total, "score_parts": parts})
    return out.withColumn(col, F.coalesce(F.col(col), F.col("rule_score").cast(df.schema[col].dataType))) if col else out


def word_count(col: str) -> Column:
    text = F.trim(F.regexp_replace(F.col(col), r"[ \t\r\n]+", " "))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def narrative_check(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.withColumn("words", word_count(col)).withColumn("too_short", F.coalesce(F.col("words") < n, F.lit(True)))


def enrich_narrative(df: DataFrame, col: str, n: int, template: str, args: list[str]) -> DataFrame:
    """Too-short narratives are followed by a sentence from a template over other columns."""
    checked = narrative_check(df, col, n)
    extra = F.format_string(template, *[F.coalesce(F.col(a).cast("string"), F.lit("unknown")) for a in args])
    return checked.withColumn(col, F.when(F.col("too_short"), F.concat_ws(" ", F.col(col), extra)).otherwise(F.col(col)))


def check_derived(df: DataFrame, col: str, expected: Column, tol: float = 0.0, out: str | None = None) -> DataFrame:
    """Recompute and compare: differs by more than the tolerance, or only one side is present."""
    c = F.col(col)
    differs = F.when(c.isNull() | expected.isNull(), c.isNull() != expected.isNull()).otherwise(F.abs(c - expected) > tol)
    return df.withColumn(out or f"{col}_inconsistent", differs)


# -- promotion ----------------------------------------------------------------------------------------

def transform_chain(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda d, step: d.transform(step), steps, df)


def promote(df: DataFrame, keys: list[str], order: list[Column | str], rules: list,
            steps: list[Callable[[DataFrame], DataFrame]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(promoted rows, quarantined rows, reconciliation): in = out + removed + quarantined."""
    unique = dedupe(transform_chain(df, steps or []), keys, order)
    judged = judge(unique, rules)
    out = judged.where(F.size("failed_rules") == 0).drop("failed_rules")
    bad = judged.where(F.size("failed_rules") > 0)
    stats = judged.agg(
        df.agg(F.count(F.lit(1))).scalar().alias("rows_in"),
        F.count_if(F.size("failed_rules") == 0).alias("rows_out"),
        F.count_if(F.size("failed_rules") > 0).alias("quarantined"),
        F.count(F.lit(1)).alias("unique_rows"),
    ).select("rows_in", "rows_out", (F.col("rows_in") - F.col("unique_rows")).alias("removed"), "quarantined",
             (F.col("rows_in") == F.col("rows_out") + F.col("rows_in") - F.col("unique_rows") + F.col("quarantined")).alias("balanced"))
    return out, bad, stats
