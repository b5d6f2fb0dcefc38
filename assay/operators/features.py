"""Feature tables of general use: rolling, lag, customer value, text chunks, vectors, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assay.functions import columns as fx
from assay.operators.ordered import AUTO, exact_quantiles, hot_keys, neighbour, rolling, running
from assay.session import cut

def rolling_features(df: DataFrame, key: str, ts: str, col: str, days: tuple[int, ...] = (7, 30),
                     scale: int | None = None) -> DataFrame:
    """Per key and day: trailing sums, counts and averages over the given numbers of days; a day without any value averages to null."""
    out = rolling(df, [key], ts, {"n": F.lit(1).cast("long"), "filled": F.col(col).isNotNull().cast("long"), "amount": fx.exact(df, col, scale)}, {f"{d}d": d for d in days}, "day")
    return out.select(
        key, F.date_from_unix_date(F.col("tick").cast("int")).alias("day"), "n", "amount",
        *[F.col(f"n_{d}d") for d in days], *[F.col(f"amount_{d}d").alias(f"sum_{d}d") for d in days],
        *[(F.col(f"amount_{d}d").cast("double") / F.nullif(F.col(f"filled_{d}d"), F.lit(0))).alias(f"avg_{d}d") for d in days])


def lag_features(df: DataFrame, key: str, order: list[str], col: str, n: int = 1, hot=AUTO) -> DataFrame:
    """Values of the ``n`` rows before, and the difference to the last one."""
    out = neighbour(df, [key], order, {f"{col}_lag{i}": (col, i) for i in range(1, n + 1)}, hot=hot)
    return out.withColumn(f"{col}_delta", F.col(col) - F.col(f"{col}_lag1"))


def logistic(x: Column, intercept: float, slope: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(intercept) + F.lit(slope) * x)))


def with_quartile(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add 1 to 4 by the exact quartile borders of the column, without ordering the table in one task."""
    q = exact_quantiles(df, col, {"a": 0.25, "b": 0.5, "c": 0.75})
    borders = q.agg(F.struct(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in "abc"]).alias("s")).scalar()
    marked = df.withColumn("__q", borders)
    return marked.withColumn(out, sum((F.when(F.col(col) > F.col(f"__q.{k}"), 1).otherwise(0) for k in "abc"), F.lit(1))).drop("__q")


def customer_features(customers: DataFrame, key: str, orders: DataFrame, fk: str, ts: str, amount: str, as_of: str,
                      churn: tuple[float, float] = (-3.0, 0.01), scale: int | None = None) -> DataFrame:
    """Lifetime value, recency, frequency, average amount, churn score and value segment per customer.

    The churn score is a documented logistic of recency in days with the caller's intercept and slope;
    it is not a trained model. Segments are quartiles of lifetime value among customers with orders.
    """
    per = orders.groupBy(F.col(fk).alias(key)).agg(
        F.count(F.lit(1)).alias("frequency"), F.sum(fx.exact(orders, amount, scale)).alias("lifetime_value"),
        F.datediff(F.lit(as_of).cast("date"), F.max(ts).cast("date")).alias("recency_days"))
    per = cut(per)  # read for the quartiles, for their borders and for the result
    scored = with_quartile(per, "lifetime_value", "segment").withColumns({
        "monetary": F.col("lifetime_value").cast("double") / F.col("frequency"), "churn_score": logistic(F.col("recency_days"), *churn)})
    return customers.select(key).join(scored, key, "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))


def chunk_text(df: DataFrame, id: str, col: str, size: int = 512, overlap: int = 0) -> DataFrame:
    """Chunks of at most ``size`` whitespace tokens over the whole text; neighbours share ``overlap`` tokens."""
    tokens = F.filter(F.split(F.col(col), r"[ \t\r\n]+"), lambda w: w != "")
    step = size - overlap
    starts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil((F.size("__t") - overlap) / F.lit(step)).cast("int") - 1, F.lit(0))), lambda i: i * step)
    return (
        df.select(id, tokens.alias("__t")).where(F.size("__t") > 0)
        .select(id, "__t", F.posexplode(starts).alias("chunk_no", "__start"))
        .select(id, "chunk_no", F.slice("__t", F.col("__start") + 1, size).alias("__c"))
        .select(id, "chunk_no", F.size("__c").alias("n_tokens"), F.array_join("__c", " ").alias("chunk"))
    )


def _word_grams(words: str, n: int) -> Column:
    """All runs of ``n`` neighbouring words, joined by a space."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def hash_embed(df: DataFrame, id: str, col: str, dim: int = 128, ngram: int = 1) -> DataFrame:
    """Vector of fixed length from the hashed word n-grams (1 to ``ngram``), scaled to length one.

    Empty texts give the zero vector.

    A deterministic stand-in for a model. Place and sign of a token come from digits of its MD5, so collisions
    cancel instead of adding up. Everything happens inside the row: the tokens' codes (place and sign) are sorted, and the lengths of
    the runs of equal codes are laid out with the gaps between them, in one go; nothing is shuffled or looked up.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = [F.col("__w")] + [_word_grams("__w", n) for n in range(2, ngram + 1)]
    # nine digits of one digest: eight for the place, the last for the sign
    place = lambda x: (F.shiftright(x, 4) % dim) * 2 + x.bitwiseAND(F.lit(1))
    numbers = F.transform("__g", lambda w: fx.digest_number(w, 1, 9))  # once a token; the place needs it twice
    codes = F.sort_array(F.transform(numbers, lambda x: place(x).cast("int")))
    n = F.size("__c")
    ends = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
                    lambda i: (i == n) | (F.get("__c", i - 1) != F.get("__c", i)))
    code = lambda e: F.get("__c", e - 1)
    before = lambda j: F.get("__e", j - 1)
    gap = lambda e, j: F.array_repeat(F.lit(0), code(e) - F.coalesce(code(before(j)), F.lit(-1)) - 1)
    runs = F.flatten(F.transform("__e", lambda e, j: F.concat(gap(e, j), F.array(e - F.coalesce(before(j), F.lit(0))))))
    rest = F.array_repeat(F.lit(0), 2 * dim - 1 - F.coalesce(F.get("__c", n - 1), F.lit(-1)))
    values = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.get("__m", i * 2) - F.get("__m", i * 2 + 1)).cast("double"))
    norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x))
    return (
        df.select(id, words.alias("__w")).select(id, (F.concat(*grams) if ngram > 1 else grams[0]).alias("__g"))
        .select(id, codes.alias("__c")).select(id, "__c", ends.alias("__e")).select(id, F.concat(runs, rest).alias("__m")).select(id, values.alias("__v")).select(id, "__v", norm.alias("__n"))
        .select(id, F.transform("__v", lambda x: x / F.when(F.col("__n") > 0, F.col("__n")).otherwise(1.0)).alias("vector")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label; each coordinate is averaged with map-side combining."""
    means = df.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def normalise(df: DataFrame, cols: list[str], how: str = "zscore", scale: int | None = None) -> DataFrame:
    """Add ``{col}_norm``: z-score (population deviation) or min-max, from one aggregate over all columns."""
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"n_{c}"), F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}")]
        if how != "minmax":
            aggs += [F.sum(fx.exact(df, c, scale)).cast("double").alias(f"s_{c}"), F.sum(fx.exact_square(df, c, scale)).cast("double").alias(f"q_{c}")]
    one = df.agg(*aggs)
    s = lambda n, c: F.col(f"__s.{n}_{c}")
    def norm(c):
        if how == "minmax":
            return F.when(s("hi", c) > s("lo", c), (F.col(c) - s("lo", c)) / (s("hi", c) - s("lo", c)))
        mean = s("s", c) / s("n", c)
        sd = F.sqrt(F.greatest(s("q", c) / s("n", c) - mean * mean, F.lit(0.0)))
        return F.when(sd > 0, (F.col(c) - mean) / sd)
    figures = df.withColumn("__s", one.select(F.struct(*one.columns).alias("s")).scalar())
    return figures.withColumns({f"{c}_norm": norm(c) for c in cols}).drop("__s")


def encode(df: DataFrame, col: str, order: list[str], one_hot: bool = True) -> DataFrame:
    """Ordinal code (1..n in the given order, 0 for others) and one-hot vector."""
    values = F.array(*[F.lit(v) for v in order])
    out = df.withColumn(f"{col}_code", F.coalesce(F.array_position(values, F.col(col)), F.lit(0)).cast("int"))
    if one_hot:
        out = out.withColumn(f"{col}_onehot", F.transform(values, lambda v: F.when(F.col(col) == v, 1).otherwise(0)))
    return out


def temporal_features(df: DataFrame, key: str, order: list[str], hot=AUTO) -> DataFrame:
    """Hour, weekday (1 = Sunday) and seconds since the key's previous event."""
    ts = order[0]
    out = neighbour(df, [key], order, {"__prev": (ts, 1)}, hot=hot)
    secs = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return out.withColumns({"hour": F.hour(F.col(ts)), "weekday": F.dayofweek(ts), "gap_seconds": secs(ts) - secs("__prev")}).drop("__prev")


def bucket_counts(df: DataFrame, key: str, bucket: Column, values: list) -> DataFrame:
    """Events per key and bucket as columns, from the buckets named by the caller (no extra pass to find them)."""
    return df.withColumn("__b", bucket).groupBy(key).pivot("__b", values).agg(F.count(F.lit(1))).fillna(0)


def risk_vector(df: DataFrame, parts: dict[str, Column], bands: list[tuple[int, str]]) -> DataFrame:
    """Vector of the named parts, their sum as score, and the first band whose upper limit is not exceeded."""
    score = sum((e for e in parts.values()), F.lit(0))
    band = F.lit(None).cast("string")
    for limit, name in reversed(bands):
        band = F.when(F.col("score") <= limit, name).otherwise(band)
    return df.withColumns({"vector": F.array(*[e.cast("double") for e in parts.values()]), "score": score}).withColumn("band", band)


def sessions(df: DataFrame, keys: list[str], order: list[str], gap_seconds: int, out: str = "session", hot=AUTO) -> DataFrame:
    """Number the stretches of a key's events that are separated by more than ``gap_seconds``."""
    found = hot_keys(df, keys, order) if hot is AUTO else hot
    before = neighbour(df, keys, order, {"__prev": (order[0], 1)}, hot=found)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    opens = F.when(F.col("__prev").isNull() | (micros(order[0]) - micros("__prev") > gap_seconds * 1_000_000), 1).otherwise(0)
    return running(before.withColumn("__opens", opens), keys, order, {out: F.col("__opens")}, hot=found).drop("__prev", "__opens")


def dedupe_alerts(df: DataFrame, keys: list[str], order: list[str], gap_seconds: int, hot=AUTO) -> DataFrame:
    """One alert per burst: first and last time and number of merged alerts."""
    ts = order[0]
    return sessions(df, keys, order, gap_seconds, hot=hot).groupBy(*keys, "session").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("merged"))


def tag_typology(df: DataFrame, tags: dict[str, Column]) -> DataFrame:
    return df.withColumn("typologies", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tags.items()])))
