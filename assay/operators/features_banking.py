"""Banking feature tables: velocity, structuring, risk view, expected loss, ratios, insured deposits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assay.functions import columns as fx
from assay.operators.ordered import AUTO, neighbour, rolling

MONEY = "decimal(18,2)"


def is_round(amount: Column, unit: int = 1000) -> Column:
    return (amount > 0) & (amount % unit == 0)


def txn_features(df: DataFrame, key: str, ts: str, amount: str, cross_border: Column, limit: float, band: float = 0.1,
                 unit: int = 1000, days: tuple[int, ...] = (1, 7, 30), scale: int | None = None) -> DataFrame:
    """Per key and day: trailing counts and sums, cross-border and round-amount share, amounts just below the limit."""
    a = fx.exact(df, amount, scale)
    near = (F.col(amount) >= limit * (1 - band)) & (F.col(amount) < limit)
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    ticks = rolling(df, [key], ts, {"n": F.lit(1).cast("long"), "amount": a, "cross": one(cross_border),
                                    "round": one(is_round(F.col(amount), unit)), "near": one(near)}, {f"{d}d": d for d in days}, "day")
    last = f"{days[-1]}d"
    return ticks.select(
        key, F.date_from_unix_date(F.col("tick").cast("int")).alias("day"),
        *[F.col(f"n_{d}d").alias(f"velocity_{d}d") for d in days], *[F.col(f"amount_{d}d").alias(f"sum_{d}d") for d in days],
        (F.col(f"cross_{last}") / F.col(f"n_{last}")).alias("cross_border_ratio"),
        (F.col(f"round_{last}") / F.col(f"n_{last}")).alias("round_ratio"), F.col(f"near_{last}").alias("structuring_score"))


def structuring(df: DataFrame, key: str, ts: str, amount: str, limit: float, band: float, days: int, least: int,
                scale: int | None = None) -> DataFrame:
    """Days on which a key has at least ``least`` amounts just below the limit within the trailing days."""
    near = (F.col(amount) >= limit * (1 - band)) & (F.col(amount) < limit)
    ticks = rolling(df.where(near), [key], ts, {"n": F.lit(1).cast("long"), "amount": fx.exact(df, amount, scale)}, {"w": days}, "day")
    return ticks.where(F.col("n_w") >= least).select(
        key, F.date_from_unix_date(F.col("tick").cast("int")).alias("day"), F.col("n_w").alias("n"), F.col("amount_w").alias("amount"))


def round_share(df: DataFrame, key: str, amount: str, unit: int = 1000) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_round(F.col(amount), unit)).alias("round_n"))


def customer_risk(customers: DataFrame, accounts: DataFrame, hits: DataFrame, kyc_fields: list[str], as_of: str) -> DataFrame:
    """KYC score, PEP flag, sanctions hits, account vintage and due-diligence tier per customer.

    HIGH with a sanctions hit or a PEP flag, MEDIUM with a KYC score under 80, else LOW: our rule.
    """
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in kyc_fields), F.lit(0))
    opened = accounts.groupBy("customer_id").agg(F.min("opened_date").alias("__first"), F.count(F.lit(1)).alias("accounts"))
    found = hits.groupBy("customer_id").agg(F.count(F.lit(1)).alias("sanctions_hits"))
    out = customers.withColumn("kyc_score", F.floor(F.lit(100) * filled / len(kyc_fields)).cast("int"))
    out = out.join(opened, "customer_id", "left").join(found, "customer_id", "left")
    hits_n = F.coalesce("sanctions_hits", F.lit(0))
    pep = F.coalesce(F.col("pep_flag").cast("boolean"), F.lit(False))
    return out.select(
        "customer_id", "kyc_score", pep.alias("pep"), hits_n.alias("sanctions_hits"), F.coalesce("accounts", F.lit(0)).alias("accounts"),
        F.datediff(F.lit(as_of).cast("date"), F.col("__first").cast("date")).alias("vintage_days"),
        F.when((hits_n > 0) | pep, "HIGH").when(F.col("kyc_score") < 80, "MEDIUM").otherwise("LOW").alias("cdd_tier"))


def account_features(txns: DataFrame, key: str, ts: str, amount: str, as_of: str, days: int = 365, scale: int | None = None) -> DataFrame:
    """Volatility, mean and dormancy of each account's activity, from exact sums."""
    per = txns.groupBy(key).agg(F.count(amount).alias("n"), F.sum(fx.exact(txns, amount, scale)).cast("double").alias("s"),
                                F.sum(fx.exact_square(txns, amount, scale)).cast("double").alias("q"), F.max(ts).alias("last"))
    mean = F.col("s") / F.col("n")
    idle = F.datediff(F.lit(as_of).cast("date"), F.col("last").cast("date"))
    return per.select(key, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("volatility"),
                      idle.alias("idle_days"), (idle > days).alias("dormant"))


def usage_features(txns: DataFrame, key: str, category: str, remote: Column) -> DataFrame:
    """Merchant diversity (distinct categories) and card-not-present share per card.

    Distinct categories are counted on one condensed line per (card, category).
    """
    per = txns.groupBy(key, category).agg(F.count(F.lit(1)).alias("n"), F.count_if(remote).alias("r"))
    return per.groupBy(key).agg(F.sum("n").alias("uses"), F.count(category).alias("diversity"), (F.sum("r") / F.sum("n")).alias("remote_ratio"))


def bene_features(benes: DataFrame, high_risk: list[str], hits: DataFrame) -> DataFrame:
    """Jurisdiction risk, verification, sanctions proximity (smallest distance) and number of payers per beneficiary."""
    near = hits.groupBy("beneficiary_id").agg(F.min("distance").alias("nearest_hit"))
    shared = benes.groupBy("account_number").agg(F.count_distinct("customer_id").alias("payers"))
    return benes.join(near, "beneficiary_id", "left").join(shared, "account_number", "left").select(
        "beneficiary_id", F.col("bank_country").isin(high_risk).alias("high_risk_country"),
        F.coalesce(F.col("verified").cast("boolean"), F.lit(False)).alias("verified"), "nearest_hit", F.coalesce("payers", F.lit(0)).alias("payers"))


def alert_features(alerts: DataFrame, by: str, false_positive: Column, narrative: Column) -> DataFrame:
    """False-positive rate of resolved alerts and share of complete narratives per source."""
    return alerts.groupBy(by).agg(
        F.count(F.lit(1)).alias("alerts"), F.count("resolution_code").alias("resolved"),
        F.coalesce(F.count_if(false_positive) / F.nullif(F.count("resolution_code"), F.lit(0)), F.lit(0.0)).alias("false_positive_rate"),
        (F.count_if(narrative) / F.count(F.lit(1))).alias("narrative_rate"))


def branch_features(accounts: DataFrame, loans: DataFrame, branch: str = "branch_id") -> DataFrame:
    """Deposits, loans and their ratio per branch; loans count for the branch of their account."""
    owed = loans.groupBy("account_id").agg(F.sum(F.col("outstanding_balance").cast(MONEY)).alias("loan"))
    joined = accounts.join(owed, "account_id", "left")
    return joined.groupBy(branch).agg(
        F.sum(F.col("balance").cast(MONEY)).alias("deposits"), F.coalesce(F.sum("loan"), F.lit(0).cast(MONEY)).alias("loans"),
    ).withColumn("deposit_to_loan", F.when(F.col("loans") > 0, F.round((F.col("deposits") / F.col("loans")).cast("double"), 4)))


def travel_anomaly(uses: DataFrame, key: str, order: list[str], lat: str, lon: str, max_kmh: float, hot=AUTO) -> DataFrame:
    """Consecutive uses of a card whose distance would need more than ``max_kmh``."""
    ts = order[0]
    prev = neighbour(uses, [key], order, {"__t": (ts, 1), "__lat": (lat, 1), "__lon": (lon, 1)}, hot=hot)
    rad = lambda c: F.radians(F.col(c))
    h = F.pow(F.sin((rad(lat) - rad("__lat")) / 2), 2) + F.cos(rad(lat)) * F.cos(rad("__lat")) * F.pow(F.sin((rad(lon) - rad("__lon")) / 2), 2)
    km = 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    hours = (F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.col("__t").cast("timestamp"))) / 3600.0
    return prev.withColumns({"km": km, "anomaly": F.coalesce(km > hours * max_kmh, F.lit(False))}).drop("__t", "__lat", "__lon")


def expected_loss(loans: DataFrame, params: DataFrame, segment: str, exposure: str, scenario: str | None = None) -> DataFrame:
    """PD × LGD × EAD per loan. ``params``: (segment, lo, hi, pd, lgd[, scenario]), bands closed-open.

    ``in_band`` is false for a loan that no band covers; its loss is unknown (null), and ``reserve`` counts it apart.
    The segment is joined by equality, the band within it; scenarios multiply lines as wanted.
    """
    cols = [F.col(segment).alias("__segment"), "lo", "hi", "pd", "lgd"] + ([scenario] if scenario else [])
    on = (F.col(segment) == F.col("__segment")) & (F.col(exposure) >= F.col("lo")) & (F.col(exposure) < F.col("hi"))
    loss = (F.col("pd").cast("decimal(9,6)") * F.col("lgd").cast("decimal(9,6)")).cast("decimal(12,8)") * F.greatest(F.col(exposure).cast(MONEY), F.lit(0).cast(MONEY))
    return loans.join(params.select(*cols), on, "left").withColumns({"expected_loss": loss, "in_band": F.col("pd").isNotNull()}).drop("__segment", "lo", "hi")


def reserve(losses: DataFrame, by: list[str]) -> DataFrame:
    """Expected loss per group, the loans behind it, and the number of loans that no band covers."""
    return losses.groupBy(*by).agg(F.count(F.lit(1)).alias("loans"), F.sum("expected_loss").alias("reserve"), F.count_if(~F.col("in_band")).alias("unrated"))


def concentration(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Share of each group in the total."""
    sums = df.groupBy(*by).agg(F.sum(F.col(amount).cast(MONEY)).alias("amount"))
    total = df.agg(F.sum(F.col(amount).cast(MONEY))).scalar()
    return sums.withColumn("share", F.col("amount").cast("double") / total.cast("double"))


def dscr(df: DataFrame, income: str, debt_service: str) -> DataFrame:
    return df.withColumn("dscr", F.when(F.col(debt_service) > 0, F.round(F.col(income) / F.col(debt_service), 4)))


def insured(df: DataFrame, by: list[str], balance: str, cap: float = 250_000) -> DataFrame:
    """Deposits per owner and category, the part under the cap and the rest. Negative balances do not offset."""
    held = F.sum(F.greatest(F.col(balance).cast(MONEY), F.lit(0).cast(MONEY)))
    return df.groupBy(*by).agg(held.alias("deposits")).withColumns({
        "insured": F.least(F.col("deposits"), F.lit(cap).cast(MONEY)),
        "uninsured": F.greatest(F.col("deposits") - F.lit(cap).cast(MONEY), F.lit(0).cast(MONEY))})


def capital_class(ratio: Column, bands: list[tuple[float, str]], last: str) -> Column:
    """First band whose lower limit the ratio reaches; ``bands`` in falling order."""
    out = F.lit(last)
    for low, name in reversed(bands):
        out = F.when(ratio >= low, name).otherwise(out)
    return out
